"""Candidates of line_dedup: bands of long lines, short lists, and methods that HotSpot compiles."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from modq.llm import line_dedup, linking
from modq.session import MOST_BYTECODE, short_methods


def sets_of(spark, n, both, own):
    """n pairs of sets of which both hashes are common and own are the larger one's alone."""
    some = lambda kind, k: F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.xxhash64("h", F.lit(kind), i))
    ids = spark.range(n).select(F.col("id").alias("h"))
    small = ids.select("h", F.lit(0).alias("g"), F.sort_array(some(0, both)).alias("hashes"))
    return small.union(ids.select("h", F.lit(1).alias("g"), F.sort_array(F.concat(some(0, both), some(1, own))).alias("hashes")))


@pytest.mark.parametrize("both, own", [(124, 31), (153, 38), (154, 38), (200, 50)])
def test_links_meet_across_tiers(spark, both, own):
    """Also where the smaller set is below a tier and the larger one in it."""
    signed = line_dedup.signatures(sets_of(spark, 500, both, own))
    one, two = signed.where("g = 0").select("h", F.col("bands").alias("a")), signed.where("g = 1").select("h", F.col("bands").alias("b"))
    assert one.join(two, "h").where(F.arrays_overlap("a", "b")).count() >= 490


def test_unlike_long_lines_seldom_meet(spark):
    """Sets of 200 hashes at similarity 0.25: fewer than half of those that bands of six hashes would let meet, 17 * 0.25**6 of them."""
    n = 6000
    some = lambda kind, k: F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.xxhash64("h", F.lit(kind), i))
    of = lambda g: spark.range(n).select(F.col("id").alias("h"), F.lit(g).alias("g"), F.sort_array(F.concat(some(0, 80), some(g, 120))).alias("hashes"))
    got = line_dedup.signatures(of(1).union(of(2)))
    one, two = got.where("g = 1").select("h", F.col("bands").alias("a")), got.where("g = 2").select("h", F.col("bands").alias("b"))
    assert one.join(two, "h").where(F.arrays_overlap("a", "b")).count() < n * line_dedup.BANDS * 0.25**line_dedup.ROWS / 2


@pytest.mark.parametrize("compared", [0, 4])
def test_short_lists_need_no_whole_sets(spark, compared):
    """Lists 1 and 2: the pivot's pairs aren't links, another pair is. Short ones are compared as they are; the result is the same."""
    sets = {1: {1, 2, 3}, 2: {11, 12, 13}, 3: {11, 12, 13}, 4: {21, 22, 23}, 5: {31, 32, 33}, 6: {31, 32, 33}, 7: {41, 42, 43}}
    rows = [(v, node, 3, -10 * (node in (1, 4)) + 0) for v, nodes in ((1, (1, 2, 3)), (2, (4, 5, 6, 7))) for node in nodes]
    asked = []

    def verify(pairs):
        return pairs.where("(a = 2 and b = 3) or (a = 5 and b = 6)")

    def whole_sets(nodes):
        asked.extend(sorted(r["node"] for r in nodes.collect()))
        known = spark.createDataFrame([(n, v) for n, s in sets.items() for v in s], "node long, value long")
        return known.join(nodes, "node", "left_semi")

    out = linking.link(spark.createDataFrame(rows, "value long, node long, n long, rank long"), verify, whole_sets, 80, compared)
    assert {(r["node"], r["component"]) for r in out.collect()} == {(2, 2), (3, 2), (5, 5), (6, 5)}
    assert asked == ([] if compared else [1, 2, 3, 4, 5, 6, 7])


def test_methods_are_short_inside_only(spark):
    limit = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(limit, None)
    with pytest.raises(ValueError), short_methods(spark):
        assert spark.conf.get(limit) == MOST_BYTECODE
        raise ValueError
    assert spark.conf.get(limit, None) == before
    spark.conf.set(limit, "9000")
    try:
        with short_methods(spark):
            assert spark.conf.get(limit) == "9000"
    finally:
        spark.conf.unset(limit)


def test_bands_meet_part_by_part(spark, monkeypatch):
    """No shuffle of values holds all of them, no value is in two parts, and the bands are gone when texts are gathered."""
    asked, kept, there = [], {}, []
    matched, wrote = line_dedup.matching, line_dedup.written

    def matching(rows, small, keys, how="inner"):
        if keys == ["value"]:
            asked.append((rows.count(), {r["value"] for r in small.select("value").collect()}))
        return matched(rows, small, keys, how)

    def written(df, name):
        if name == "texts":
            there.append(Path(kept["bands"].written_to.removeprefix("file://")).exists())
        kept[name] = wrote(df, name)
        if name == "bands":
            wanted = [F.size(c) for c in df.columns if c.startswith(("part", "bands"))]
            kept["values"] = kept[name].select(F.sum(sum(wanted[1:], wanted[0]))).first()[0]
        return kept[name]

    monkeypatch.setattr(line_dedup, "matching", matching)
    monkeypatch.setattr(line_dedup, "written", written)
    line_dedup.line_components(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert sum(n for n, _ in asked) == kept["values"] and max(n for n, _ in asked) < 0.4 * kept["values"]
    assert sum(len(v) for _, v in asked) == len(set().union(*(v for _, v in asked))) > 0
    assert there == [False]
