"""Versioned tables: immutable segments of Parquet, a manifest for each version, and writers that can't undo each other.

A table is a folder that all executors share: data/segment=.../profile=.../ holds rows, light/ the same way a few light columns of them, versions/ a
manifest for each version: which profiles of which segments are live, their rows, and which batch each stream has written last. A
manifest appears at once, by a rename that fails if another writer was faster; then the change is made again on the newer version. Readers stay on the
version that they opened. A writer that dies leaves files that no manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modq.session import delete, file_system

#: Times that a change is made again because another writer was faster.
TRIES = 10
NULL = "__HIVE_DEFAULT_PARTITION__"


class Version(NamedTuple):
    """number; entries: segment, profile, rows, most (the largest value of the table's counter, an id) of each live part; ledger: last batch of each writer."""

    number: int
    entries: tuple[dict, ...]
    ledger: dict[str, int]

    def largest(self) -> dict[str | None, int]:
        """The largest counter of each profile."""
        out: dict[str | None, int] = {}
        for e in self.entries:
            if e["most"] is not None:
                out[e["profile"]] = max(out.get(e["profile"], e["most"]), e["most"])
        return out

    def rows(self) -> dict[str | None, int]:
        out: dict[str | None, int] = {}
        for e in self.entries:
            out[e["profile"]] = out.get(e["profile"], 0) + e["rows"]
        return out


class Conflict(Exception):
    """Another writer has published a version meanwhile."""


class VersionedTable:
    """A table of rows with a column profile, by which changes are bounded. schema: DDL of its columns; counter: the column whose largest value is kept,
    if any; light: columns that are also kept apart, of each profile's rows.

    What the driver holds is a manifest: a row for each profile and segment, as Spark's own listing of partitions is. compact() makes
    one segment of all.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, counter: str | None = None, light: tuple[str, ...] = ()):
        self.spark, self.path, self.schema, self.counter, self.light = spark, path.rstrip("/"), schema, counter, light

    def numbers(self) -> list[int]:
        fs, folder = file_system(self.spark, f"{self.path}/versions")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def version(self, number: int) -> Version:
        fs, file = file_system(self.spark, f"{self.path}/versions/{number:012d}.json")
        stream = fs.open(file)
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Version(number, tuple(found["entries"]), found["ledger"])

    def current(self) -> Version:
        numbers = self.numbers()
        return self.version(numbers[-1]) if numbers else Version(0, (), {})

    def publish(self, version: Version) -> None:
        """Make version the current one; Conflict if its number is taken."""
        spark, body = self.spark, json.dumps({"entries": list(version.entries), "ledger": version.ledger})
        fs, draft = file_system(spark, f"{self.path}/drafts/{uuid.uuid4().hex}")
        stream = fs.create(draft)
        try:
            stream.write(bytearray(body.encode()))
        finally:
            stream.close()
        fs.mkdirs(file_system(spark, f"{self.path}/versions")[1])
        _, final = file_system(spark, f"{self.path}/versions/{version.number:012d}.json")
        jvm = spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark._jsparkSession.sessionState().newHadoopConf())
        no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(files.makeQualified(draft), files.makeQualified(final), no_options)
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            fs.delete(draft, False)
            raise Conflict(version.number) from e

    def _scan(self, kind: str, schema: str, version: Version, profiles: list[str | None] | None) -> DataFrame:
        entries = [e for e in version.entries if profiles is None or e["profile"] in profiles]
        if not entries:
            return self.spark.createDataFrame([], schema)
        names: dict[str, list] = {}
        for e in entries:
            names.setdefault(e["segment"], []).append(e["profile"])
        wanted = F.lit(False)
        for segment, live in names.items():
            named = F.col("profile").isin([p for p in live if p is not None])
            wanted = wanted | ((F.col("segment") == segment) & (named | F.col("profile").isNull() if None in live else named))
        columns = self.spark.createDataFrame([], schema).columns
        paths = [f"{self.path}/{kind}/segment={s}" for s in names]
        rows = self.spark.read.option("basePath", f"{self.path}/{kind}").schema(f"{schema}, segment string").parquet(*paths)
        return rows.where(wanted).select(*columns)

    def read(self, version: Version | None = None, profiles: list[str | None] | None = None) -> DataFrame:
        """The rows of a version (default: the current one), of some profiles or all. Parts that aren't asked for aren't read."""
        return self._scan("data", self.schema, version or self.current(), profiles)

    def read_light(self, version: Version | None = None, profiles: list[str | None] | None = None) -> DataFrame:
        """profile and the light columns of the rows."""
        kinds = {c.name: c.dataType.simpleString() for c in self.spark.createDataFrame([], self.schema).schema}
        return self._scan("light", ", ".join(f"{c} {kinds[c]}" for c in ("profile", *self.light)), version or self.current(), profiles)

    def _segment(self, rows: DataFrame) -> tuple[str, list[dict]]:
        """Write rows as a new segment; its name and entries."""
        name = uuid.uuid4().hex
        columns = self.spark.createDataFrame([], self.schema).columns
        path = f"{self.path}/data/segment={name}"
        rows.select(*columns).write.partitionBy("profile").parquet(path)
        try:
            made = self.spark.read.schema(self.schema).parquet(path)
        except PySparkException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return name, []
        if self.light:
            made.select("profile", *self.light).write.partitionBy("profile").parquet(f"{self.path}/light/segment={name}")
        most = F.max(self.counter) if self.counter else F.lit(None).cast("bigint")
        parts = made.groupBy("profile").agg(F.count("*").alias("rows"), most.alias("most")).collect()
        return name, [{"segment": name, "profile": r["profile"], "rows": r["rows"], "most": r["most"]} for r in parts]

    def commit(self, change: Callable[[Version], tuple[DataFrame, list[str | None] | None]], writer: str | None = None, batch: int | None = None) -> Version:
        """Publish the version after the current one: change(version) gives new rows and the profiles whose rows they replace (none: they are added; None: all).

        A writer's batch that the ledger has already is left out, so a repeated batch adds nothing. If another writer is faster, change is asked again.
        """
        for _ in range(TRIES):
            old = self.current()
            if writer is not None and old.ledger.get(writer, -1) >= batch:
                return old
            rows, replaced = change(old)
            name, entries = self._segment(rows)
            kept = () if replaced is None else tuple(e for e in old.entries if e["profile"] not in replaced)
            ledger = old.ledger if writer is None else old.ledger | {writer: batch}
            new = Version(old.number + 1, (*kept, *entries), ledger)
            try:
                self.publish(new)
                return new
            except Conflict:
                for kind in ("data", "light"):
                    delete(self.spark, f"{self.path}/{kind}/segment={name}")
        raise Conflict(f"{TRIES} other writers were faster")

    def append(self, rows: DataFrame, writer: str | None = None, batch: int | None = None) -> Version:
        return self.commit(lambda _: (rows, []), writer, batch)

    def merge(self, changed: DataFrame, keys: list[str], writer: str | None = None, batch: int | None = None) -> Version:
        """Put changed's rows in the place of those with equal keys (profile among them). Only profiles that changed has are written."""
        touched = [r["profile"] for r in changed.select("profile").distinct().collect()]

        def change(old: Version) -> tuple[DataFrame, list[str | None]]:
            new = changed.select(*[F.col(k).alias(f"new_{k}") for k in keys]).distinct()
            same = F.lit(True)
            for k in keys:
                same = same & F.col(k).eqNullSafe(F.col(f"new_{k}"))
            return self.read(old, touched).join(new, same, "left_anti").unionByName(changed), touched

        return self.commit(change, writer, batch)

    def rewrite(self, profiles: list[str | None], change: Callable[[DataFrame], DataFrame]) -> Version:
        """Put change(their rows) in the place of the rows of these profiles; others' files stay as they are."""
        return self.commit(lambda old: (change(self.read(old, profiles)), profiles)) if profiles else self.current()

    def compact(self) -> Version:
        """All live rows in one segment."""
        return self.commit(lambda old: (self.read(old), None))

    def vacuum(self, keep: int = 1) -> None:
        """Delete all but the last `keep` versions, and segments that none of them names: no writer may be at work, no reader on an older version."""
        numbers = self.numbers()
        live = {e["segment"] for n in numbers[-keep:] for e in self.version(n).entries}
        for n in numbers[:-keep]:
            delete(self.spark, f"{self.path}/versions/{n:012d}.json")
        for kind in ("data", "light"):
            fs, folder = file_system(self.spark, f"{self.path}/{kind}")
            for s in fs.listStatus(folder) if fs.exists(folder) else []:
                if s.getPath().getName().removeprefix("segment=") not in live:
                    fs.delete(s.getPath(), True)
