"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modq.session import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
#: Documents that one prefix-sum window holds, about.
WINDOW_ROWS = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target from source, source_size (one row per source).

    Sources by code point, null last, weigh weights[0], weights[1], ... repeating. Target =
    min(most * source_size, weight * level), where level makes the targets' sum share * all sizes:
    sources sorted by cap / weight, the k with the least ratios are capped,
    and the smallest k holds whose level does not exceed the next ratio.
    """
    ranked = totals.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", "place", weight.cast("long").alias("weight"), (F.col("source_size") * most).alias("cap"))
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")), "place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped, weighed = F.coalesce(F.sum("cap").over(before), F.lit(0)), F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - capped) / (F.sum("weight").over(everything) - weighed)
    levels = ranked.withColumn("level", level).withColumn("holds", F.col("level") <= F.col("cap") / F.col("weight"))
    first = F.first(F.when(F.col("holds"), F.col("level")), ignorenulls=True).over(everything)
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * first, F.col("cap").cast("double")))
    return levels.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix") -> DataFrame:
    """docs' rows (doc_id, source, size, source_size, target, n_full, n_partial, taken, mix_key, text_key).

    Size: words of the whole text. Every document gets the key md5(seed:doc_id); within a source,
    documents stand in key order. A source with target T = e * source_size + r is taken e
    times whole and once more up to its r-th word in key order: n_full = e, n_partial = the
    document's words within that last cut, taken = n_full * size + n_partial. The
    sources' budgets are met to the word.

    Prefix sums are distributed: the uniform keys cut a source into equal ranges of about
    WINDOW_ROWS documents; range totals are summed over ranges, documents within a range.
    The result depends on keys alone, not on the ranges.

    Null text: size 0. Null source: a source of its own, last. Null doc_id: key of the empty id, kept.
    Ties: by doc_id, size, a hash of the text. Repeated rows: each counts. Empty table: no rows. Other columns are ignored.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("mix_key"), F.xxhash64("text").alias("text_key"))
    rows = written(rows, "sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    totals = written(totals, "sources")  # read back with its size known: small, Spark broadcasts it
    targets = source_targets(totals.select("source", "source_size"), weights, share, most).join(totals.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    targets = written(targets, "targets")
    wide = F.ceil(F.col("n") / F.lit(WINDOW_ROWS))
    bin_of = F.floor(F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("long") * wide / F.lit(1 << 32)).cast("long")
    sized = rows.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).withColumn("bin", bin_of).drop("s", "n")
    ranges = sized.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("source").alias("s"), F.col("bin").alias("b"), F.coalesce(F.sum("bin_size").over(before), F.lit(0)).alias("bin_before"))
    ranges = written(ranges, "ranges")
    within = Window.partitionBy("source", "bin").orderBy("mix_key", "doc_id", "size", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(ranges, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
    budget = F.round("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - full * F.col("source_size")
    partial = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("bin_before") - F.col("within"))).cast("long")
    out = placed.withColumn("n_full", full).withColumn("n_partial", partial)
    return out.select("doc_id", "source", "size", "source_size", "target", "n_full", "n_partial", (F.col("n_full") * F.col("size") + F.col("n_partial")).alias("taken"), "mix_key", "text_key")


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: docs' rows, once for each whole time that they are taken, and once more cut
    after n_partial words where the last cut ends inside them. Other columns stay as they are."""
    # rows of equal source, doc_id and text form a lot, whose rows take what is due to it one after the other
    lot = ["source", "doc_id", "text_key"]
    due = mix(docs, **settings).groupBy(*lot).agg(F.count("*").alias("n"), F.max("n_full").alias("mix_full"), F.sum("n_partial").alias("due"))
    due = written(due.select(*[F.col(c).alias(f"lot_{c}") for c in lot], "n", "mix_full", "due"), "due")
    # a row travels as one struct, so that no name of its columns meets one of these
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("d"), word_count(F.col("text")).alias("mix_words"), F.xxhash64("text").alias("mix_text"))
    same = F.col("d.source").eqNullSafe(F.col("lot_source")) & F.col("d.doc_id").eqNullSafe(F.col("lot_doc_id")) & (F.col("mix_text") == F.col("lot_text_key"))
    rows = rows.join(due, same)
    at = F.row_number().over(Window.partitionBy("lot_source", "lot_doc_id", "lot_text_key").orderBy(F.monotonically_increasing_id()))
    single = rows.where("n = 1").withColumn("mix_partial", F.col("due"))
    several = rows.where("n > 1").withColumn("mix_partial", F.greatest(F.lit(0), F.least(F.col("mix_words"), F.col("due") - (at - 1) * F.col("mix_words"))))
    rows = single.unionByName(several)
    text, none = F.col("d.text"), F.array().cast("array<string>")
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), 1, F.col("mix_partial").cast("int")), "")
    whole = F.when(F.col("mix_full") > 0, F.array_repeat(text, F.col("mix_full").cast("int"))).otherwise(none)
    last = F.when(F.col("mix_partial") <= 0, none).when(F.col("mix_partial") == F.col("mix_words"), F.array(text)).otherwise(F.array(cut))
    taken = rows.select("d", F.explode(F.concat(whole, last)).alias("taken"))
    return taken.select(F.col("d").withField("text", F.col("taken")).alias("d")).select("d.*")
