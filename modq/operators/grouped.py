"""Selection and training of many groups at once: cut-offs from histograms of sort keys, samplers and models by profile.

No group is brought to one task, nothing loops over groups on the driver, and no window runs over full rows.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modq.functions import text as T
from modq.functions.grams import hashed_vectors
from modq.operators import store
from modq.operators.train import FEATURES, RATE, SHARD, checked_features, sgd
from modq.session import release, written

#: Bins of a histogram of one group's keys, and rows of a group that a window may take: those of its last bin.
BINS, FEW = 1024, 10_000


def order_key(seed: int, *key: str) -> Column:
    """60 bits of store.draw(), as a long in the same order."""
    return F.conv(F.left(store.draw(seed, *key), F.lit(15)), 16, 10).cast("bigint")


def text_keys(text: Column, parts: int = 3) -> list[Column]:
    """Longs that order texts as their first 7 * parts bytes do."""
    raw = F.hex(F.encode(text, "utf-8"))
    return [F.conv(F.rpad(F.substring(raw, 14 * i + 1, 14), 14, "0"), 16, 10).cast("bigint") for i in range(parts)]


def cut_offs(keyed: DataFrame, by: list[str], n: DataFrame, keys: int) -> DataFrame:
    """For each group of keyed (by, k: struct of `keys` longs): by, whole (every row is taken), part, from, to, missing: rows whose keys 0 to part - 1
    are those of `fixed` and whose key `part` is below `from` are taken, and `missing` more of those with from <= key < to.

    Round by round each group's range is cut in BINS equal bins, and counts of bins say in which of them its last row lies, until that bin holds FEW
    rows or one value, from which the next key goes on. A round is one aggregation over light keys of the groups that are not done.
    """
    names = [f"k{i}" for i in range(keys)]
    light = written(keyed.select(*[F.col(c).alias(f"g_{c}") for c in by], *[F.col(f"k.{k}").alias(k) for k in names]), "keys")
    group = [f"g_{c}" for c in by]
    same = lambda side: [F.col(f"g_{c}").eqNullSafe(F.col(f"{side}_{c}")) for c in by]

    def all_of(conditions: list[Column]) -> Column:
        out = conditions[0]
        for c in conditions[1:]:
            out = out & c
        return out

    asked = n.select(*[F.col(c).alias(f"a_{c}") for c in by], F.col("n").cast("bigint").alias("missing"))
    sizes = light.groupBy(*group).agg(F.count("*").alias("size"), F.min("k0").alias("lo"), F.max("k0").alias("hi"))
    state = sizes.join(asked, all_of(same("a"))).select(
        *group, F.lit(0).alias("part"), F.array().cast("array<bigint>").alias("fixed"), "lo", (F.col("hi") + 1).alias("hi"), "missing", (F.col("size") <= F.col("missing")).alias("whole"), F.col("size").alias("held"),
    ).where("missing > 0")
    state = written(state.withColumn("done", F.col("whole") | (F.col("held") <= FEW)), "cuts")
    for _ in range(keys * 7 + 7):  # a range of 2 ** 63 values takes seven rounds
        if not state.where("not done").limit(1).count():
            break
        active = state.where("not done").select(*[F.col(g).alias(f"s_{g[2:]}") for g in group], "part", "fixed", "lo", "hi", "missing")
        value = F.element_at(F.array(*names), F.col("part") + 1)
        equal = F.lit(True)
        for i in range(keys - 1):
            equal = equal & ((F.col("part") <= i) | (F.col(names[i]) == F.try_element_at("fixed", F.lit(i + 1))))
        inside = light.join(active, all_of(same("s"))).withColumn("v", value).where(equal & (F.col("v") >= F.col("lo")) & (F.col("v") < F.col("hi")))
        # bins of whole numbers, at least one value wide
        wide = F.greatest(F.expr(f"(hi - lo + {BINS - 1}) div {BINS}"), F.lit(1))
        bins = inside.withColumn("wide", wide).withColumn("bin", F.expr("(v - lo) div wide"))
        counts = bins.groupBy(*group, "part", "fixed", "lo", "hi", "missing", "wide", "bin").agg(F.count("*").alias("c"))
        upto = F.sum("c").over(Window.partitionBy(*group).orderBy("bin"))
        last = counts.withColumn("upto", upto).where("upto >= missing and upto - c < missing")
        new_lo = F.col("lo") + F.col("bin") * F.col("wide")
        moved = last.select(*group, "part", "fixed", new_lo.alias("lo"), F.least(F.col("hi"), new_lo + F.col("wide")).alias("hi"), (F.col("missing") - F.col("upto") + F.col("c")).alias("missing"), F.col("c").alias("held"))
        one = F.col("hi") - F.col("lo") == 1
        # all of a bin's rows are taken: the cut lies behind it
        full = F.col("held") == F.col("missing")
        moved = moved.withColumn("full", full).withColumn("lo", F.when(F.col("full"), F.col("hi")).otherwise(F.col("lo"))).withColumn("missing", F.when(F.col("full"), 0).otherwise(F.col("missing")))
        done = (F.col("held") <= FEW) | (one & (F.col("part") == keys - 1)) | F.col("full")
        # one value that too many rows share: go on with the next key, over its whole range
        go_on = one & ~done
        moved = moved.withColumn("done", done).withColumn("go_on", go_on)
        moved = moved.select(*group, F.when(F.col("go_on"), F.col("part") + 1).otherwise(F.col("part")).alias("part"), F.when(F.col("go_on"), F.concat("fixed", F.array("lo"))).otherwise(F.col("fixed")).alias("fixed"),
                             F.when(F.col("go_on"), F.lit(0)).otherwise(F.col("lo")).cast("bigint").alias("lo"), F.when(F.col("go_on"), F.lit((1 << 62) - 1)).otherwise(F.col("hi")).cast("bigint").alias("hi"), "missing", F.lit(False).alias("whole"), "held", "done")
        state = written(state.where("done").unionByName(moved), "cuts")
    release(light)
    return state.select(*[F.col(g).alias(g[2:]) for g in group], "part", "fixed", F.col("lo").alias("from"), F.col("hi").alias("to"), "missing", "whole", "held")


def least_of_each(rows: DataFrame, by: list[str], n: DataFrame, keys: list[Column], ties: list[Column]) -> DataFrame:
    """The n rows of each group of rows that come first by keys (longs, not below 0 but for the first), then by ties; all if there are fewer; none for a group without a row in n (by, n).

    What comes before a group's cut-off is kept where it stands. Only the last bin's rows, FEW a group or of one value of all keys, are sorted by group.
    """
    names = [f"k{i}" for i in range(len(keys))]
    keyed = rows.select(F.struct(*[F.col(c) for c in rows.columns]).alias("r"), *[F.col(c).alias(c) for c in by], F.struct(*[k.alias(name) for k, name in zip(keys, names, strict=True)]).alias("k"), F.struct(*[t.alias(f"t{i}") for i, t in enumerate(ties)]).alias("t"))
    cuts = cut_offs(keyed, by, n, len(keys)).select(*[F.col(c).alias(f"c_{c}") for c in by], "part", "fixed", "from", "to", "missing", "whole")
    own = F.lit(True)
    for c in by:
        own = own & F.col(c).eqNullSafe(F.col(f"c_{c}"))
    found = keyed.join(cuts, own)
    values = F.array(*[F.col(f"k.{k}") for k in names])
    value = F.element_at(values, F.col("part") + 1)
    # keys before `part` decide first
    below, equal = F.lit(False), F.lit(True)
    for i in range(len(keys) - 1):
        fixed = F.try_element_at("fixed", F.lit(i + 1))
        at = F.element_at(values, i + 1)
        use = F.col("part") > i
        below = below | (use & equal & (at < fixed))
        equal = equal & (~use | (at == fixed))
    sure = F.col("whole") | below | (equal & (value < F.col("from")))
    edge = ~F.col("whole") & ~below & equal & (value >= F.col("from")) & (value < F.col("to"))
    marked = found.withColumn("state", F.when(sure, 1).when(edge, 2).otherwise(0)).where("state > 0")
    # of the rows on the edge only keys are sorted: their full rows come by their place in a written table
    edges = marked.where("state = 2").withColumn("place", F.row_number().over(Window.partitionBy(*[f"c_{c}" for c in by]).orderBy("k", "t"))).where("place <= missing")
    return marked.where("state = 1").select("r.*").unionByName(edges.select("r.*"))


def label_counts(samples: DataFrame) -> DataFrame:
    """profile, n0, n1."""
    return samples.groupBy("profile").agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") != 0).alias("n1"))


def _labelled(samples: DataFrame) -> DataFrame:
    return samples.withColumn("is1", (F.col("label") != 0).cast("int"))


def _each(counts: DataFrame, zero: Column, one: Column) -> DataFrame:
    """profile, is1, n from counts."""
    return counts.select("profile", F.explode(F.array(F.struct(F.lit(0).alias("is1"), zero.cast("bigint").alias("n")), F.struct(F.lit(1).alias("is1"), one.cast("bigint").alias("n")))).alias("x")).select("profile", "x.*")


def _take(samples: DataFrame, n: DataFrame, newest: bool, seed: int) -> DataFrame:
    keys = [-F.col("id")] if newest else [order_key(seed, "id")]
    ties = [-F.col("id")] if newest else [store.draw(seed, "id"), F.col("id")]
    return least_of_each(_labelled(samples), ["profile", "is1"], n, keys, ties).drop("is1")


def half_of(most: int | Column) -> Column:
    return F.floor((most if isinstance(most, Column) else F.lit(most)) / 2)


def balanced_samples(samples: DataFrame, limits: DataFrame, seed: int = 42) -> DataFrame:
    """The training samples of every profile at once, each by its own strategy: limits has profile, most, strategy (latest_full, random_full,
    random_duplicate, anything else: undersample).

    With half = most / 2 and a profile's n0 and n1 samples of the labels: latest_full takes up to half newest of each label, random_full up to half random ones,
    undersample min(n0, n1, half) random ones of each, random_duplicate min(half, max(n0, n1)) of each, the rarer label's rows repeated evenly. The last two
    take none if a label has none. Random: least by store.draw(). Rows of profiles without a limit aren't taken.
    """
    limits = written(limits.select("profile", F.col("most").cast("bigint").alias("most"), F.coalesce("strategy", F.lit("")).alias("strategy")).join(label_counts(samples), "profile"), "limits")
    half, both = half_of(F.col("most")), (F.col("n0") > 0) & (F.col("n1") > 0)
    under = F.when(both, F.least("n0", "n1", half)).otherwise(0)
    target = F.when(both, F.least(half, F.greatest("n0", "n1"))).otherwise(0)
    # repeated rows: target % n at random get one copy more than the others
    over = limits.where("strategy = 'random_duplicate'")
    more = lambda c: F.when(F.col(c) >= target, target).when(F.col(c) > 0, target % F.col(c)).otherwise(0)
    latest = limits.where("strategy = 'latest_full'")
    spread = limits.where("strategy = 'random_full'")
    rest = limits.where("strategy not in ('latest_full', 'random_full', 'random_duplicate')")
    random = _each(spread, half, half).unionByName(_each(rest, under, under)).unionByName(_each(over, more("n0"), more("n1")))
    taken = _take(samples, written(random, "random-limits"), False, seed).unionByName(_take(samples, written(_each(latest, half, half), "latest-limits"), True, seed))
    times = lambda c: F.when((F.col(c) > 0) & (F.col(c) < target), F.floor(target / F.col(c))).otherwise(0)
    copies = _each(over, times("n0"), times("n1")).where("n > 0").select(F.col("profile").alias("p"), F.col("is1").alias("l"), "n")
    whole = _labelled(samples).join(copies, (F.col("profile") == F.col("p")) & (F.col("is1") == F.col("l"))).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    return taken.unionByName(whole.select(*samples.columns))


def retain_profiles(samples: DataFrame, limits: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) of every profile at once: a profile with more than its `most` of limits (profile, most) keeps at most most / 2 of
    each label, at random; other profiles keep all."""
    counts = label_counts(samples).join(limits.select("profile", F.col("most").cast("bigint").alias("most")), "profile", "left")
    cut = F.col("n0") + F.col("n1") > F.col("most")
    n = written(_each(counts, F.when(cut, half_of(F.col("most"))).otherwise(F.col("n0")), F.when(cut, half_of(F.col("most"))).otherwise(F.col("n1"))), "retained")
    kept = written(_take(samples, n, False, seed), "kept-samples")
    gone = samples.join(kept.select(F.col("profile").alias("p"), F.col("id").alias("i")), (F.col("profile") == F.col("p")) & (F.col("id") == F.col("i")), "left_anti")
    return kept, gone


def train_terms_profiles(samples: DataFrame, limits: DataFrame, smooth: bool = True) -> tuple[DataFrame, DataFrame]:
    """(terms: profile, term, pass_hits, violation_hits, df, idf, weight; models: profile, model_type, intercept, n, reversed, features) of every profile's
    samples at once: train_terms() of each, with max_features of limits (profile, max_features). Profiles that lack a label get no model.

    Two aggregations, over (profile, term, sample) and (profile, term), and cut-offs of each profile's terms by difference of hits, document frequency and term.
    """
    counts = written(label_counts(samples).where("n0 > 0 and n1 > 0").join(limits.select("profile", F.col("max_features").cast("bigint").alias("n")), "profile"), "label-counts")
    of = counts.select(F.col("profile").alias("p"), "n0", "n1")
    rows = samples.join(of, F.col("profile") == F.col("p"), "left_semi")
    each = rows.select("profile", "id", "label", F.explode(T.ws_tokens(F.col("text"))).alias("term")).groupBy("profile", "term", "id", "label").agg(F.count("*").alias("c"))
    hits = lambda wanted: F.coalesce(F.sum(F.when(wanted, F.col("c"))), F.lit(0))
    stats = written(each.groupBy("profile", "term").agg(hits(F.col("label") == 0).alias("pass_hits"), hits(F.col("label") != 0).alias("violation_hits"), F.count("*").alias("df")), "term-stats")
    differ = F.abs(F.col("violation_hits") - F.col("pass_hits"))
    top = least_of_each(stats, ["profile"], counts, [-differ, (F.lit(1 << 40) - F.col("df")), *text_keys(F.col("term"))], [-differ, -F.col("df"), F.col("term")])
    top = top.join(of, F.col("profile") == F.col("p"))
    idf = F.ln((F.col("n0") + F.col("n1") + 1.0) / (F.col("df") + 1.0)) + 1.0
    weight = F.ln((F.col("violation_hits") + 1.0) / (F.col("pass_hits") + 1.0))
    terms = top.select("profile", "term", "pass_hits", "violation_hits", "df", idf.alias("idf"), weight.alias("weight"))
    models = counts.select("profile", F.lit("bow").alias("model_type"), F.ln((F.col("n1") + 1.0) / (F.col("n0") + 1.0)).alias("intercept"), (F.col("n0") + F.col("n1")).alias("n"), F.lit(False).alias("reversed"), F.lit(None).cast("string").alias("features"))
    return terms, models


def train_hashed_profiles(samples: DataFrame, epochs: int = 3, alpha: float = 1e-5, seed: int = 42, rate: float = RATE, shard: int = SHARD, **settings) -> tuple[DataFrame, DataFrame]:
    """(buckets: profile, bucket, weight; models: as train_terms_profiles()) of every profile's samples at once: train_hashed() of each, with a shard for every
    `shard` samples of a profile, at most but for the hash's unevenness. Profiles that lack a label get no model.

    SGD is keyed by (profile, shard): an epoch is one co-grouped pass in which every shard starts from its profile's averaged weights of the buckets that it
    holds, and an average by (profile, bucket) over shards. So a large profile is many tasks and a small one a part of one.
    """
    features = checked_features({k: v for k, v in settings.items() if k in FEATURES})
    counts = written(label_counts(samples).where("n0 > 0 and n1 > 0").select(F.col("profile").alias("p"), F.ln((F.col("n1") + 1.0) / (F.col("n0") + 1.0)).alias("start"), (F.col("n0") + F.col("n1")).alias("n"), F.ceil((F.col("n0") + F.col("n1")) / shard).alias("shards")), "label-counts")
    keyed = samples.select("profile", "id", F.when(F.col("label") == 0, 0.0).otherwise(1.0).alias("y"), "text").join(counts.select("p", "shards"), F.col("profile") == F.col("p"))
    rows = hashed_vectors(keyed, ["profile", "shards", "id", "y"], **features).withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")))
    data = written(rows, "hashed-samples")
    needed = written(data.select(F.col("profile").alias("owner"), F.col("shard").alias("at"), F.explode("buckets").alias("bucket")).distinct(), "shard-buckets")
    # bucket -1 is the intercept
    needed = needed.unionByName(data.select(F.col("profile").alias("owner"), F.col("shard").alias("at"), F.lit(-1).alias("bucket")).distinct())
    state = counts.select(F.col("p").alias("profile"), F.lit(-1).alias("bucket"), F.col("start").alias("weight"))
    for epoch in range(epochs):
        part = data.withColumn("turn", store.draw(seed + epoch, "id"))
        known = needed.join(state.withColumnRenamed("profile", "p").withColumnRenamed("bucket", "b"), (F.col("owner") == F.col("p")) & (F.col("bucket") == F.col("b")), "left").select("owner", "at", "bucket", F.coalesce("weight", F.lit(0.0)).alias("weight"))

        def step(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            right = right.sort_values("bucket")
            buckets, weights = right["bucket"].to_numpy(), right["weight"].to_numpy(np.float64)
            w, bias, _ = sgd(left.sort_values(["turn", "id"]), buckets[1:], weights[1:].astype(np.float32), float(weights[0]), rate, alpha)
            return pd.DataFrame({"profile": left["profile"].iloc[0], "bucket": np.append(-1, buckets[1:]).astype(np.int32), "weight": np.append(bias, w.astype(np.float64)), "n": len(left)})

        moved = part.groupBy("profile", "shard").cogroup(known.groupBy("owner", "at")).applyInPandas(step, "profile string, bucket int, weight double, n long")
        averaged = moved.groupBy("profile", "bucket").agg((F.sum(F.col("weight") * F.col("n")) / F.sum("n")).alias("weight"))
        state = written(averaged.withColumn("weight", F.when(F.col("bucket") == -1, F.col("weight")).otherwise(F.col("weight").cast("float"))), "weights")
    release(data)
    buckets = state.where("bucket >= 0 and weight <> 0").select("profile", "bucket", F.col("weight").cast("float").alias("weight"))
    biases = state.where("bucket = -1").select("profile", F.col("weight").alias("intercept"))
    models = biases.join(counts.select(F.col("p"), "n"), F.col("profile") == F.col("p")).select("profile", F.lit("hashed").alias("model_type"), "intercept", "n", F.lit(False).alias("reversed"), F.lit(json.dumps(features)).alias("features"))
    return buckets, models


__all__ = ["balanced_samples", "cut_offs", "label_counts", "least_of_each", "order_key", "retain_profiles", "text_keys", "train_hashed_profiles", "train_terms_profiles"]
