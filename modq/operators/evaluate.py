"""Threshold metrics and label statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modq.functions.text import category_class
from modq.operators.store import sample_counts


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _with_ratios(counts: DataFrame) -> DataFrame:
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return counts.withColumn("accuracy", _ratio(tp + tn, tp + tn + fp + fn)).withColumn("precision", precision).withColumn("recall", recall).withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def evaluate_sweep(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, tp, tn, fp, fn, accuracy, precision, recall, f1 for each distinct threshold, in order; 0/0 is 0.

    scored: label, p. One pass: counts by label and the number of thresholds that p reaches, a table of at most two rows
    more than thresholds, then sums over it. Thresholds outside [0, 1] are an error, and so is an empty input.
    """
    wanted = list(dict.fromkeys(float(t) for t in thresholds))
    if not wanted or any(not 0 <= t <= 1 for t in wanted):
        raise ValueError("thresholds must lie in [0, 1]")
    ordered = sorted(wanted)
    array = F.array(*map(F.lit, ordered))
    reached = F.size(F.filter(array, lambda t: F.col("p") >= t))
    bins = scored.groupBy((F.col("label") != 0).alias("actual"), reached.alias("reached")).count()
    asked = scored.sparkSession.createDataFrame([(t, i, ordered.index(t)) for i, t in enumerate(wanted)], "threshold double, place int, need int")
    of = lambda actual, hit: F.coalesce(F.sum(F.when((F.col("actual") == actual) & ((F.col("reached") > F.col("need")) == hit), F.col("count"))), F.lit(0))
    counts = F.broadcast(asked).join(bins).groupBy("threshold", "place").agg(of(True, True).alias("tp"), of(False, False).alias("tn"), of(False, True).alias("fp"), of(True, False).alias("fn"))
    return _with_ratios(counts).orderBy("place").drop("place")


def evaluate(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """evaluate_sweep at one threshold, cut to [0, 1]; an empty input is an error."""
    if scored.isEmpty():
        raise ValueError("no samples to evaluate")
    return evaluate_sweep(scored, [min(1.0, max(0.0, threshold))])


def dataset_balance(samples: DataFrame) -> DataFrame:
    counts = sample_counts(samples)
    return counts.agg(F.sum("total").alias("evaluated"), F.sum("label_1").alias("label_1"), F.sum("label_0").alias("label_0"))


def category_stats(samples: DataFrame) -> DataFrame:
    kind = category_class(F.col("category"))
    counts = samples.agg(F.count("*").alias("total"), *[F.count_if(kind == k).alias(k) for k in ("unknown", "missing", "other")])
    for k in ("unknown", "missing", "other"):
        counts = counts.withColumn(f"{k}_share", _ratio(F.col(k), F.col("total")))
    return counts


def unknown_breakdown(samples: DataFrame) -> DataFrame:
    """Unknown samples: n, by label, without date, first and last time."""
    rows = samples.where(category_class(F.col("category")) == "unknown")
    return rows.agg(F.count("*").alias("unknown"), F.count_if(F.col("label") == 0).alias("label_0"), F.count_if(F.col("label") != 0).alias("label_1"), F.count_if(F.col("created_at").isNull()).alias("missing_date"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


def unknown_by_day(samples: DataFrame) -> DataFrame:
    """day, unknown, total, ratio."""
    days = samples.where("created_at is not null").groupBy(F.to_date("created_at").alias("day"))
    return days.agg(F.count_if(category_class(F.col("category")) == "unknown").alias("unknown"), F.count("*").alias("total")).withColumn("ratio", _ratio(F.col("unknown"), F.col("total")))


def unknown_recent(samples: DataFrame, lookback_days: int, now: str) -> DataFrame:
    """unknown_by_day from max(1, lookback_days) days before now on; the filter reaches the scan."""
    since = F.date_sub(F.to_date(F.lit(now)), max(1, lookback_days))
    return unknown_by_day(samples.where(F.to_date("created_at") >= since))


def top_days(samples: DataFrame, by: str = "count", n: int = 10, min_total: int = 50) -> DataFrame:
    """The n days of most unknown samples, or by ratio among days of min_total samples or more; ties: the earlier day."""
    days = unknown_by_day(samples).where("unknown > 0")
    if by == "ratio":
        return days.where(F.col("total") >= min_total).orderBy(F.desc("ratio"), "day").limit(n)
    return days.orderBy(F.desc("unknown"), "day").limit(n)
