"""Exact linking of near-duplicates over inverted lists, and connected components, as Spark jobs."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modq.session import release, written


#: Retained values per set, and the chance that a link may be missed with by a sketch.
SKETCH, MISS = 32, 1e-6
#: Rows of a table that may be broadcast, about 50 MB of a hash table of longs.
MOST_BROADCAST = 500_000


def matching(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined to small, a written table of longs, which is broadcast if it has no more than MOST_BROADCAST
    rows: then rows needn't be shuffled. Larger, both are shuffled."""
    few = small.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return rows.join(F.broadcast(small) if few else small, keys, how)


def least_common(threshold: int) -> int:
    """The most values c of SKETCH for which two sets at the threshold have fewer than c in common with a chance below MISS.

    Each retained value is a common one with chance threshold / 100.
    """
    s = threshold / 100
    chance, c = 0.0, 0
    while (chance := chance + math.comb(SKETCH, c) * s**c * (1 - s) ** (SKETCH - c)) < MISS and c < SKETCH:
        c += 1
    return c


def sketch_filter(sketches: DataFrame, threshold: int) -> Callable[[DataFrame], DataFrame]:
    """Pairs a, b to those whose sketches (node, sketch: a set's SKETCH least hashes) may be of a link: of the links
    at the threshold it drops less than one in a million."""

    def likely(pairs: DataFrame) -> DataFrame:
        rough = pairs.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a").join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
        # of the SKETCH least hashes of both sets, the share that both hold
        rough = rough.select("a", "b", F.array_intersect("sa", "sb").alias("both"), F.slice(F.sort_array(F.array_union("sa", "sb")), 1, SKETCH).alias("least"))
        return rough.where(F.size(F.array_intersect("both", "least")) * SKETCH >= F.size("least") * least_common(threshold)).select("a", "b")

    return likely


def prints(items: DataFrame, words: int) -> DataFrame:
    """node, n, bits0, ...: size and parity bitmap of 64 * words bits of every set (items: node, value, whole sets of hashes)."""
    bit = F.pmod(F.xxhash64("value"), F.lit(64 * words)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit") % 64)
    each = items.select("node", bit.alias("bit")).groupBy("node", F.shiftright("bit", 6).alias("word")).agg(F.count("*").alias("n"), F.bit_xor(one).alias("bits"))
    return each.groupBy("node").agg(F.sum("n").alias("n"), *[F.coalesce(F.bit_xor(F.when(F.col("word") == i, F.col("bits"))), F.lit(0).cast("long")).alias(f"bits{i}") for i in range(words)])


def print_filter(made: DataFrame, threshold: int, words: int) -> Callable[[DataFrame], DataFrame]:
    """Pairs a, b to those whose sizes and bitmaps (made: prints()) may be of a link. No link is lost."""
    one, two = [made.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), *[F.col(f"bits{i}").alias(f"{x}{i}") for i in range(words)]) for x in "ab"]

    def likely(pairs: DataFrame) -> DataFrame:
        return pairs.join(one, "a").join(two, "b").where(may_be_near(threshold, words)).select("a", "b")

    return likely


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that it reaches) for every node of edges a, b.

    Alternating large-star and small-star rounds (Kiveris et al., SoCC 2014): every round
    is two aggregations and joins over the edges, whose number never grows; neighbours
    are never gathered in one place. Each round is written to the shared folder.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        """Edges u > v. Large: the larger neighbours of u, small: u and its smaller neighbours, all to the least of u's."""
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y"))
        if large:
            both = both.union(e.select("v", "u"))
        least = both.groupBy("x").agg(F.min("y").alias("low")).select(F.col("x").alias("n"), F.least("x", "low").alias("m"))
        moved = both.join(least, F.col("x") == F.col("n"))
        if large:
            out = moved.where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
        else:
            out = moved.where("y <> m").select(F.col("y").alias("u"), F.col("m").alias("v")).union(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    def print_of(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = print_of(e)
    while before[0]:
        old, e = e, written(star(star(e, True), False), "edges")
        release(old)
        now = print_of(e)
        if now == before:
            break
        before = now
    out = written(e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct()), "components")
    release(e)
    return out


#: Words of 64 bits of a set's parity bitmap.
WORDS = 4


def parity(value: Column, word: int) -> Column:
    """What a value adds, by exclusive or, to a word of its set's bitmap: one bit of all words, by its hash."""
    bit = F.pmod(F.xxhash64(value), F.lit(64 * WORDS)).cast("int")
    return F.when(F.shiftright(bit, 6) == word, F.call_function("shiftleft", F.lit(1).cast("long"), bit % 64)).otherwise(F.lit(0).cast("long"))


def prefix_postings(items: DataFrame, threshold: int) -> DataFrame:
    """value, node, n, place, bits0, ...: the lists that every pair of 100 * |A & B| >= threshold * |A | B| shares; items: node, value, whole sets.

    Both sets of such a pair have at least ceil(threshold * n / 100) values in common, so with all values in
    one order, each must find a common one among its first n - ceil(threshold * n / 100) + 1. The
    order is by rarity: what only one node has is in no list. bits: the whole set's parity bitmap, for may_be_near().
    """
    shared = items.groupBy("value").agg(F.count("*").alias("nodes"))
    by = Window.partitionBy("node")
    ranked = items.join(shared, "value").withColumn("place", F.row_number().over(by.orderBy("nodes", "value"))).withColumn("n", F.count("*").over(by))
    bits = [f"bits{i}" for i in range(WORDS)]
    ranked = ranked.withColumns({b: F.bit_xor(parity(F.col("value"), i)).over(by) for i, b in enumerate(bits)})
    room = F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1
    return ranked.where((F.col("place") <= room) & (F.col("nodes") > 1)).select("value", "node", "n", "place", *bits)


def may_overlap(threshold: int) -> Column:
    """Whether a value at places pa and pb of sets of na and nb values can be the first of enough common ones:
    no more than 1 + min(na - pa, nb - pb) can be, and threshold / (100 + threshold) * (na + nb) must. The
    first common value of every link meets it (Xiao et al., WWW 2008)."""
    return (F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + 1) * (100 + threshold) >= (F.col("na") + F.col("nb")) * threshold


def may_be_near(threshold: int, words: int = WORDS) -> Column:
    """Whether two sets whose bitmaps are a0, ... and b0, ... can be a link. Bitmaps differ in no more bits than the sets do in values, which are
    (100 - threshold) / (100 + threshold) * (na + nb) at most. No link is lost (Sandes et al., bitmap filter, 2020)."""
    apart = F.lit(0)
    for i in range(words):
        apart = apart + F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}")))
    return apart * (100 + threshold) <= (F.col("na") + F.col("nb")) * (100 - threshold)


def link(postings: DataFrame, verify: Callable[[DataFrame], DataFrame], whole_sets: Callable[[DataFrame], DataFrame], threshold: int, compared: int = 0, near: DataFrame | None = None) -> DataFrame:
    """node, component for nodes that share a list (others are linked with nothing).

    postings: value, node, n (set size), rank (lower: likelier to be in the middle of its near copies).
    verify: pairs a, b to those of them that are links. whole_sets: nodes to node, value rows. near: prints() of the nodes, if there are any.

    Comparing all of a list of n nodes would take n * n / 2 pairs. So each list first compares its nodes
    with one, the lowest by rank: of a group of near copies most join it there. Lists that still span
    several components are left. Those of no more than `compared` nodes are compared pair by pair, which is no more than half of that for each row of
    postings; it suits lists that unlike sets seldom share. With near, pairs whose bitmaps are too far apart aren't made: versions of one line that are no
    links to each other are many, with the square of their number. The others' nodes' whole sets go through prefix_postings(), which drops all
    that is too far from everything, and what then shares a list in different components, at places that leave room for a
    link and with bitmaps that are near enough, is compared pair by pair. No link between components is missed; pairs within one can't change it.
    """
    pivots = postings.groupBy("value").agg(F.min(F.struct("rank", "node", "n")).alias("p"), F.count("*").alias("nodes")).where("nodes > 1")
    pivots = pivots.select("value", F.col("p.node").alias("pivot"), F.col("p.n").alias("n_pivot"))
    sizes = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * threshold
    pairs = postings.join(pivots, "value").where((F.col("node") != F.col("pivot")) & sizes("n", "n_pivot"))
    pairs = written(pairs.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct(), "pairs")
    edges = written(verify(pairs), "links")
    known = components(edges)
    at = postings.select("value", "node", "n").join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # the only pair of a list of two has been compared
    open_ = at.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("nodes")).where("low <> high and nodes > 2").select("value", "nodes")
    open_ = written(open_, "open")
    short = at.join(open_.where(F.col("nodes") <= compared).select("value"), "value")
    bits = [c for c in near.columns if c.startswith("bits")] if near else []
    if near:
        short = short.join(near.select("node", *bits), "node")
    one, two = [[F.col(c).alias(f"{x}{i}") for i, c in enumerate(bits)] for x in "ab"]
    direct = short.select("value", F.col("node").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), *one).join(short.select(F.col("value").alias("v"), F.col("node").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), *two), F.col("value") == F.col("v"))
    direct = direct.where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & sizes("na", "nb") & may_be_near(threshold, len(bits))).select("a", "b")
    left = written(at.join(open_.where(F.col("nodes") > compared), "value", "left_semi").select("node", "component").distinct(), "spread")
    finer = prefix_postings(whole_sets(left.select("node")), threshold)
    finer = written(finer.join(left, "node"), "finer")
    one = finer.select("value", F.col("node").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("place").alias("pa"), *[F.col(f"bits{i}").alias(f"a{i}") for i in range(WORDS)])
    two = finer.select(F.col("value").alias("v"), F.col("node").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("place").alias("pb"), *[F.col(f"bits{i}").alias(f"b{i}") for i in range(WORDS)])
    more = one.join(two, (F.col("value") == F.col("v")) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & may_overlap(threshold) & may_be_near(threshold))
    more = more.select("a", "b")
    more = written((more.union(direct) if compared else more).distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
    found = written(verify(more), "links")
    out = known if found.isEmpty() else components(edges.union(found))
    release(pairs, edges, open_, left, finer, more, found, *([known] if out is not known else []))
    return out
