"""Repair of stored counts and pointers from raw sample records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modq.operators import store
from modq.sources.versions import Version, VersionedTable

META = "profile string, name string, value bigint"


def meta_table(spark: SparkSession, path: str) -> VersionedTable:
    """profile, name, value: counts, next id and newest-id pointers, under path."""
    return VersionedTable(spark, path, META)


def repair(meta: VersionedTable, raw: DataFrame, dry_run: bool = True) -> tuple[DataFrame, Version]:
    """(profile, name, stored, rebuilt: what differs; the version that holds it, or without dry_run the one after it, which holds what was rebuilt).

    raw: raw_samples(). A corrupt record counts in its profile's total and in neither label, and has no pointer; a missing hash is computed. Only profiles in which
    something differs are written; what is stored for profiles without any record goes.
    """
    old = meta.current()
    drift = store.meta_drift(raw, meta.read(old))
    if dry_run:
        return drift, old
    touched = [r["profile"] for r in drift.select("profile").distinct().collect()]  # a row for each profile
    if not touched:
        return drift, old
    fresh = store.rebuild_meta(raw)
    named = F.col("profile").isin([p for p in touched if p is not None])
    wanted = named | F.col("profile").isNull() if None in touched else named
    return drift, meta.commit(lambda _: (fresh.where(wanted), touched))
