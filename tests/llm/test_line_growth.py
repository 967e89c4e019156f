"""What of line_dedup must not grow with the square of the lines: pairs that are stored, and lists of unlike lines."""

import random

import pytest
from pyspark.sql import functions as F

from modq.llm import line_dedup, linking


def hashed(spark, sets):
    rows = [(node, x) for node, s in sets.items() for x in s]
    return spark.createDataFrame(rows, "node long, value long")


def similar(rng, n, share):
    """Two sets of n values with a similarity of share."""
    both = round(n * 2 * share / (1 + share))
    of = lambda k: {rng.getrandbits(62) for _ in range(k)}
    common = of(both)
    return common | of(n - both), common | of(n - both)


def test_prints_keep_links_and_leave_the_rest(spark):
    """All pairs at 0.8 and above stay; of those at 0.65, which a sketch of 32 hashes lets through, nearly none."""
    rng = random.Random(5)
    sets = {}
    for i in range(300):
        sets[4 * i], sets[4 * i + 1] = similar(rng, rng.randint(6, 1500), rng.uniform(0.81, 1))
        sets[4 * i + 2], sets[4 * i + 3] = similar(rng, rng.randint(150, 900), 0.65)
    made = linking.prints(hashed(spark, sets), line_dedup.WORDS)
    assert {r["node"]: r["n"] for r in made.collect()} == {k: len(s) for k, s in sets.items()}
    pairs = spark.createDataFrame([(k, k + 1) for k in sets if k % 2 == 0], "a long, b long")
    kept = {r["a"] for r in linking.print_filter(made, 80, line_dedup.WORDS)(pairs).collect()}
    links = {k for k in sets if k % 2 == 0 and len(sets[k] & sets[k + 1]) >= 0.8 * len(sets[k] | sets[k + 1])}
    assert links <= kept and {4 * i for i in range(300)} >= links and len(kept - links) < 15


def test_short_lists_make_no_pairs_of_far_sets(spark):
    """A list of 30 versions of a line, none of which is a link to another: of 435 pairs only those with the pivot are asked for."""
    rng = random.Random(6)
    base = [rng.getrandbits(62) for _ in range(300)]
    sets = {i: {*base[:200], *(rng.getrandbits(62) for _ in range(100))} for i in range(30)}
    items, asked = hashed(spark, sets), []

    def verify(pairs):
        asked.append(pairs.count())
        return pairs.where("false")

    lists = spark.createDataFrame([(1, i, 300, i) for i in sets], "value long, node long, n long, rank long")
    out = linking.link(lists, verify, lambda nodes: items.join(nodes, "node", "left_semi"), 80, line_dedup.COMPARED, linking.prints(items, line_dedup.WORDS))
    assert out.count() == 0 and asked == [29, 0]


@pytest.mark.parametrize("n, share, rows", [(500, 0.35, 8), (1000, 0.45, 11)])
def test_the_longer_lines_are_the_seldomer_unlike_ones_meet(spark, n, share, rows):
    """No more than bands of so many rows promise; bands of seven would let share**7 * 22 of the pairs meet."""
    pairs, both = 3000, round(n * 2 * share / (1 + share))
    some = lambda kind, k: F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.xxhash64("h", F.lit(kind), i))
    of = lambda g: spark.range(pairs).select(F.col("id").alias("h"), F.lit(g).alias("g"), F.sort_array(F.concat(some(0, both), some(g, n - both))).alias("hashes"))
    signed = line_dedup.signatures(of(1).union(of(2)))
    one, two = signed.where("g = 1").select("h", F.col("bands").alias("a")), signed.where("g = 2").select("h", F.col("bands").alias("b"))
    met = one.join(two, "h").where(F.arrays_overlap("a", "b")).count()
    assert met < pairs * share**7 * 22 / 1.5
    bands = next(b for _, b, r in line_dedup.TIERS if r == rows)
    assert met < 2 * pairs * (share**rows * bands + (share**7 * 22 if n * 80 <= 399 * 100 else 0)) + 10


@pytest.mark.parametrize("both, own", [(399, 99), (400, 100), (799, 199), (800, 200), (1600, 400)])
def test_long_links_meet(spark, both, own):
    n = 500
    some = lambda kind, k: F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.xxhash64("h", F.lit(kind), i))
    ids = spark.range(n).select(F.col("id").alias("h"))
    small = ids.select("h", F.lit(0).alias("g"), F.sort_array(some(0, both)).alias("hashes"))
    signed = line_dedup.signatures(small.union(ids.select("h", F.lit(1).alias("g"), F.sort_array(F.concat(some(0, both), some(1, own))).alias("hashes"))))
    one, two = signed.where("g = 0").select("h", F.col("bands").alias("a")), signed.where("g = 1").select("h", F.col("bands").alias("b"))
    assert one.join(two, "h").where(F.arrays_overlap("a", "b")).count() >= 490
