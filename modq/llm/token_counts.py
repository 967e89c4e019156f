"""Token counts through a digest cache."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modq.llm import tokens
from modq.llm.linking import matching
from modq.session import fresh_path, prepare, written

VOCABULARY = "byte_bpe_50k.json"
CACHE_SCHEMA = "digest string, n_tokens long"


def read_cache(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """Stored counts of one tokenizer version; empty where none are stored. A digest that was appended twice has equal rows."""
    path = f"{cache}/tokenizer={tokens.version(tokenizer)}"
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def count_tokens(docs: DataFrame, cache: str | None = None, tokenizer: str = VOCABULARY, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), digest for every row of docs.

    The normalised content is the text itself, null as empty; its SHA-256 and the digest of
    the vocabulary file are the key. Digests that the cache at path `cache` lacks
    are encoded once each, over the whole text, and appended; all other rows only join. Light
    rows decide what is missing, so text moves only for missing digests, and of a
    group of copies only the row with the smallest doc_id (of equal rows, all) moves.

    Null doc_id: kept as a row. Repeated rows: one result each. Empty tables: no rows.
    Columns beyond doc_id and text are ignored. Without `cache`, a new one is used.
    """
    spark = docs.sparkSession
    prepare(spark)
    cache = cache or fresh_path(spark, "token-cache")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.sha2(text, 256).alias("digest"))
    light = written(keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    wanted = written(light.groupBy("digest").agg(F.min("doc_id").alias("owner")), "wanted")
    # a small batch is broadcast to the stored counts, which then are read but not shuffled
    hits = matching(read_cache(spark, cache, tokenizer), wanted.select("digest"), ["digest"], "left_semi").dropDuplicates(["digest"])
    lacking = written(wanted.join(hits, "digest", "left_anti"), "misses").withColumnRenamed("digest", "missing")
    owned = keyed.join(lacking, (keyed.digest == lacking.missing) & keyed.doc_id.eqNullSafe(lacking.owner), "left_semi")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer)
        for b in batches:
            sizes = [len(x) for x in encoder.ids(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], names=["digest", "n_tokens"])

    fresh = owned.select("digest", "text").mapInArrow(encode, CACHE_SCHEMA).dropDuplicates(["digest"])  # of equal rows
    fresh.write.mode("append").parquet(f"{cache}/tokenizer={tokens.version(tokenizer)}")
    counts = matching(read_cache(spark, cache, tokenizer), wanted.select("digest"), ["digest"], "left_semi").dropDuplicates(["digest"])
    found = light.join(counts, "digest")
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "digest")
