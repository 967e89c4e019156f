"""The sample store as a versioned table that changes: appends, lookups, retention that rewrites, running counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modq.functions.text import text_hash
from modq.operators import store
from modq.operators.grouped import retain_profiles
from modq.sources.versions import Version, VersionedTable

COUNTS = "profile string, label int, n bigint"


def sample_table(spark: SparkSession, path: str) -> VersionedTable:
    """Samples (store.SCHEMA) under path, with text_hash and id kept apart as pointers."""
    return VersionedTable(spark, path, store.SCHEMA, "id", ("text_hash", "id"))


def counts_table(spark: SparkSession, path: str) -> VersionedTable:
    """profile, label, n under path."""
    return VersionedTable(spark, path, COUNTS)


def append_new(table: VersionedTable, new: DataFrame, writer: str | None = None, batch: int | None = None, now: Column | None = None) -> Version:
    """Append new (profile, text, label, category) as samples whose ids go on from each profile's largest, which the manifest knows: nothing stored is read.
    A batch that its writer has appended before adds nothing."""

    def change(old: Version) -> tuple[DataFrame, list]:
        last = table.spark.createDataFrame([(p, i) for p, i in old.largest().items() if p is not None], "profile string, id bigint")
        return store.append_samples(new, last, now), []

    return table.commit(change, writer, batch)


def import_samples(table: VersionedTable, samples: DataFrame) -> Version:
    """Append samples (store.SCHEMA) with the ids that they have; a missing hash is computed."""
    return table.append(samples.withColumn("text_hash", F.coalesce("text_hash", text_hash(F.col("text")))))


def pointers(table: VersionedTable, version: Version | None = None) -> DataFrame:
    """profile, text_hash, id: the newest sample of each text hash. Texts aren't read."""
    return table.read_light(version).groupBy("profile", "text_hash").agg(F.max("id").alias("id"))


def lookup(table: VersionedTable, texts: DataFrame, version: Version | None = None) -> DataFrame:
    """store.lookup_by_text() for texts (profile, text, more) on a version: hashes meet the pointers, and only samples of a hash that is
    asked for are read further."""
    version = version or table.current()
    asked = texts.select("profile", text_hash(F.col("text")).alias("text_hash")).distinct()
    ids = table.read_light(version).join(asked, ["profile", "text_hash"], "left_semi").select("profile", "id").distinct()
    return store.lookup_by_text(texts, table.read(version).join(ids, ["profile", "id"], "left_semi"))


def retain(table: VersionedTable, limits: DataFrame, seed: int = 42) -> Version:
    """Cut every profile with more than its `most` samples (limits: profile, most) to at most most / 2 of each label, at random. Only those profiles
    are written; their pointers come with the same version. The numbers of samples are the manifest's."""
    have = table.current().rows()
    most = {r["profile"]: r["most"] for r in limits.collect()}  # a row for each profile, as the manifest has
    over = [p for p, n in have.items() if p in most and n > most[p]]
    return table.rewrite(over, lambda rows: retain_profiles(rows, limits, seed)[0])


def upsert_counts(table: VersionedTable, changed: DataFrame, writer: str, batch: int) -> Version:
    """Put changed totals (profile, label, n) in the place of the stored ones; other profiles aren't touched, a repeated batch changes nothing."""
    return table.merge(changed, ["profile", "label"], writer, batch)
