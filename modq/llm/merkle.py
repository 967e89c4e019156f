"""Merkle manifest of a dataset: trees of runs of FAN nodes by lag and lead windows, proofs, and their check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modq.functions.text import ascii_lower
from modq.session import release, written

FAN = 8
#: Nodes of one window, whole runs of them.
BLOCK = FAN * 512
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: What monotonically_increasing_id() adds for each partition.
PART = 1 << 33


def field(value: Column) -> Column:
    """A value as the leaves have it: its bytes' number and the value, - if null."""
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(*[field(text if c == "text" else F.col(c)) for c in FIELDS]), 256)


def placed(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """rows, written, with place: their number within their group, from 0, nulls first. Neither a group nor equal rows meet in one task.

    Rows are range-sorted once. A row's number in its sorted range, less that of its group's first row there, plus the
    group's rows in ranges before: one small row for each group and range.
    """
    ranged = rows.repartitionByRange(F.col(group).asc_nulls_first(), *order).sortWithinPartitions(F.col(group).asc_nulls_first(), *order)
    at = F.monotonically_increasing_id()
    ranged = written(ranged.withColumn("at", at).withColumn("part", F.floor(F.col("at") / PART)), "ranged")
    parts = ranged.groupBy(F.col(group).alias("g"), F.col("part").alias("p")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("g").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("g", "p", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    out = ranged.join(starts, (F.col("part") == F.col("p")) & F.col(group).eqNullSafe(F.col("g")))
    return out.withColumn("place", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "g", "p", "first", "before")


def level(nodes: DataFrame, group: str) -> DataFrame:
    """nodes (group, place, n: the group's nodes, digest) with before and after: the digests of the others of a node's run, joined."""
    slot, run_end = F.col("place") % FAN, F.least(F.col("n"), (F.floor(F.col("place") / FAN) + 1) * FAN)
    w = Window.partitionBy(group, "block").orderBy("place")
    blocks = nodes.withColumn("block", F.floor(F.col("place") / BLOCK))
    lags = [F.when(slot >= k, F.lag("digest", k).over(w)) for k in range(FAN - 1, 0, -1)]
    leads = [F.when(F.col("place") + k < run_end, F.lead("digest", k).over(w)) for k in range(1, FAN)]
    return blocks.select(*nodes.columns, F.concat_ws("", *lags).alias("before"), F.concat_ws("", *leads).alias("after"))


STEP = "struct<before:string,after:string>"


def tree(leaves: DataFrame, group: str, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """(leaves with path, subroots) from leaves (group, place, n, digest and keep).

    path: before and after of the node and of its parents, up to that below the subroot; empty for a lone leaf.
    subroots: group, subroot. Levels are made upwards, each an eighth of the one below, and paths are handed down.
    """
    levels, roots, nodes = [], None, leaves
    while True:
        lone = nodes.where("n = 1").select(group, F.col("digest").alias("subroot"))
        roots = lone if roots is None else roots.unionByName(lone)
        many = nodes if not levels else nodes.where("n > 1")
        if levels and not many.limit(1).count():
            break
        levels.append(written(level(many, group), "level"))
        parents = levels[-1].where(f"place % {FAN} = 0 and n > 1").select(group, F.expr(f"place div {FAN}").alias("place"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), F.sha2(F.concat("digest", "after"), 256).alias("digest"))
        nodes = written(parents, "parents")
        if not nodes.limit(1).count():
            break
    own = F.array(F.struct("before", "after")).cast(f"array<{STEP}>")
    above = None
    for rows in reversed(levels):
        path = F.when(F.col("n") > 1, own).otherwise(F.array().cast(f"array<{STEP}>"))
        cols = [group, "place", "n", "digest", *(keep if rows is levels[0] else [])]
        if above is None:
            rows = rows.select(*cols, path.alias("path"))
        else:
            parent = above.select(F.col(group).alias("g"), F.col("place").alias("run"), F.col("path").alias("rest"))
            rows = rows.join(parent, (F.expr(f"place div {FAN}") == F.col("run")) & F.col(group).eqNullSafe(F.col("g")), "left")
            rows = rows.select(*cols, F.concat(path, F.coalesce("rest", F.array().cast(f"array<{STEP}>"))).alias("path"))
        above = rows
    return above, roots


def numbered(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """placed() with n, the rows of each group."""
    out = placed(rows, group, *order)
    sizes = rows.groupBy(F.col(group).alias("of")).agg(F.count("*").alias("n"))
    return out.join(sizes, F.col(group).eqNullSafe(F.col("of"))).drop("of")


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest leads to along path."""
    return F.aggregate(path, digest, lambda d, s: F.sha2(F.concat(s.before, d, s.after), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, path of every row of docs (doc_id, source, lang, n_chars, text), and tampered_leaf.

    A leaf is the SHA-256 of the five fields. The leaves of a language stand by doc_id; every FAN neighbours (the last ones: fewer)
    become one node, until one is left, its subroot; the subroots, by language, become the root likewise. path has, from the
    leaf to the root, the digests before and after it in its run: with them anybody who knows the root can check a row alone.
    tampered_leaf: that of the text with A-Z lower-cased.

    Languages of any size, also all rows in one: windows hold BLOCK nodes. Null doc_id: before all others; null
    language: a group of its own, the first. Ties of doc_id: by leaf. Repeated rows: a leaf each. Empty table: no rows. Other
    columns don't count.
    """
    light = docs.select("doc_id", "lang", leaf(F.col("text")).alias("digest"), leaf(ascii_lower(F.col("text"))).alias("tampered_leaf"))
    light = written(light, "leaves")
    leaves = written(numbered(light, "lang", F.col("doc_id").asc_nulls_first(), F.col("digest"), F.monotonically_increasing_id()), "placed")
    paths, subroots = tree(leaves, "lang", ["doc_id", "tampered_leaf"])
    subroots = written(subroots, "subroots")
    # languages are nodes of one group, by their bytes: Spark compares strings so
    tops = subroots.select(F.lit(0).alias("all"), "lang", F.col("subroot").alias("digest"))
    tops, root = tree(written(numbered(tops, "all", F.col("lang").asc_nulls_first()), "placed-subroots"), "all", ["lang"])
    tops = written(tops.select(F.col("lang").alias("of"), F.col("digest").alias("subroot"), F.col("path").alias("top")).join(F.broadcast(root.select(F.col("subroot").alias("root")).limit(1))), "tops")
    out = paths.join(tops, F.col("lang").eqNullSafe(F.col("of")))
    return out.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.concat("path", "top").alias("path"), "tampered_leaf")


def proof(path: Column) -> Column:
    """The SHA-256 of a path's digests, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s.before, s.after)), ""), 256)


def checked(found: DataFrame) -> DataFrame:
    """manifest()'s rows with the check of every document, of which a third is tampered with: where 3 divides the crc32 of its id."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    now = F.when(tampered, F.col("tampered_leaf")).otherwise(F.col("leaf"))
    out = found.withColumn("proof_sha256", proof(F.col("path"))).withColumn("folded_root", folded(now, F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
