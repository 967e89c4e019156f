"""Sources and sinks: samples, keyword lists, request logs, reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modq.functions.text import ascii_lower, json_of, trimmed
from modq.operators.store import SCHEMA


def read_samples(spark: SparkSession, path: str, profile: str | None = None, limit: int | None = None, kind: str = "parquet") -> DataFrame:
    """Samples of a Parquet table partitioned by profile, or of a JSON export whose corrupt lines are skipped."""
    if kind == "json":
        rows = raw_samples(spark, path).where("raw is null").drop("raw")
    else:
        rows = spark.read.schema(SCHEMA).parquet(path)
    rows = rows if profile is None else rows.where(F.col("profile") == profile)
    return rows if limit is None else rows.limit(limit)


def raw_samples(spark: SparkSession, path: str) -> DataFrame:
    """The records of a JSON export (profile=.../ folders, or profile as a field), a line each: the columns of samples, and raw, which is null but for a corrupt
    line: no JSON object, fields of other types, or no id. All else of such a row is null but its profile. A time that is not yyyy-MM-dd HH:mm:ss is null."""
    lines = spark.read.text(path)
    folder = [c for c in lines.columns if c == "profile"]
    fields = ", ".join(f"{n} {'string' if n == 'created_at' else t}" for n, t in (c.split() for c in SCHEMA.split(", ")) if n not in folder)
    parsed = F.from_json("value", f"{fields}, broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    rows = lines.select(*[F.col(c).cast("string").alias(c) for c in folder], "value", parsed.alias("s"))
    corrupt = F.col("s.broken").isNotNull() | F.col("s.id").isNull()
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    value = {n: F.when(~corrupt, F.col(f"s.{n}")) for n in names if n not in folder}
    value["created_at"] = F.try_to_timestamp(value["created_at"], F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    return rows.select(*[value[n].alias(n) if n in value else F.col(n) for n in names], F.when(corrupt, F.col("value")).alias("raw"))


def write_samples(samples: DataFrame, path: str) -> None:
    samples.write.mode("append").partitionBy("profile").parquet(path)


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """pos, original, normalized of a keyword list: one a line, # starts a comment; no file: no keywords."""
    try:
        lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "pos int, original string, normalized string")
    return keywords_of(lines)


def keywords_of(lines: DataFrame) -> DataFrame:
    word = trimmed(F.col("line"))
    return lines.select("pos", word.alias("original"), ascii_lower(word).alias("normalized")).where("original <> '' and not startswith(original, '#')")


def read_requests(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """request_id, profile, path, headers, body, and whether the body is JSON; an unreadable one is null, not an error."""
    schema = "request_id string, profile string, path string, headers map<string,string>, body string"
    rows = spark.read.schema(schema).json(path) if kind == "json" else spark.read.schema(schema).parquet(path)
    return rows.withColumn("readable", json_of(F.col("body")).isNotNull())


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)
