"""Training of term models and hashed models, and when to train."""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modq.functions import text as T
from modq.functions.grams import hashed_vectors
from modq.operators.store import draw
from modq.session import release, written

RATE = 0.35
#: Samples of a shard, at most but for the hash's unevenness.
SHARD = 1250


def label_counts(samples: DataFrame) -> tuple[int, int]:
    """(label 0, others); an error if either is missing."""
    zero, one = samples.agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") != 0)).first()
    if not zero or not one:
        raise ValueError("training needs samples of both labels")
    return zero, one


def train_terms(samples: DataFrame, max_features: int) -> tuple[DataFrame, float]:
    """(term, pass_hits, violation_hits, df, idf, weight; intercept) of the max_features terms whose hits differ most.

    One aggregation over (token, sample) counts and one over tokens; the top comes from a limited sort.
    """
    zero, one = label_counts(samples)
    n = zero + one
    each = samples.select("id", "label", F.explode(T.ws_tokens(F.col("text"))).alias("term")).groupBy("term", "id", "label").count()
    stats = each.groupBy("term").agg(
        F.coalesce(F.sum(F.when(F.col("label") == 0, F.col("count"))), F.lit(0)).alias("pass_hits"),
        F.coalesce(F.sum(F.when(F.col("label") != 0, F.col("count"))), F.lit(0)).alias("violation_hits"),
        F.count("*").alias("df"),
    )
    top = stats.orderBy(F.abs(F.col("violation_hits") - F.col("pass_hits")).desc(), F.desc("df"), "term").limit(max_features)
    terms = top.withColumn("idf", F.ln((F.lit(n) + 1.0) / (F.col("df") + 1.0)) + 1.0).withColumn("weight", F.ln((F.col("violation_hits") + 1.0) / (F.col("pass_hits") + 1.0)))
    return terms, math.log((one + 1) / (zero + 1))


def sgd(rows: pd.DataFrame, buckets: np.ndarray | None, w: np.ndarray, bias: float, rate: float, alpha: float, deadline: float | None = None) -> tuple[np.ndarray, float, int]:
    """(weights, intercept, rows gone through) after one pass over rows (y, buckets, values) in their order.

    error = y - p; intercept += rate * error; weight += rate * (error * value - alpha * weight) on the row's buckets, in 32-bit floats. w: the
    weights of `buckets`, ascending, or with None of all buckets. No further row is begun after deadline (time.time()).
    """
    w, decay = w.copy(), float(np.float32(alpha))
    if not len(rows):
        return w, bias, 0
    for done, (y, values, own_buckets) in enumerate(zip(rows["y"], rows["values"], rows["buckets"], strict=True)):
        if deadline is not None and done % 32 == 0 and time.time() >= deadline:
            return w, bias, done
        at = own_buckets.astype(np.int64, copy=False) if buckets is None else np.searchsorted(buckets, own_buckets)
        own = w[at]
        z = bias + float(own.astype(np.float64) @ values)
        p = 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))
        error = y - p
        bias += rate * error
        w[at] = own + (rate * (error * values - decay * own)).astype(np.float32)
    return w, bias, len(rows)


def _epoch(shared: Broadcast, at_start: float, rate: float, alpha: float, deadline: float | None) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A shard's part of an epoch, from the weights of all buckets: the intercept (bucket -1) and the touched buckets, and how many rows moved them."""

    def step(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["turn", "id"])
        moved, bias, done = sgd(frame, None, shared.value, at_start, rate, alpha, deadline)
        held = np.zeros(moved.size, bool)
        for own in frame["buckets"].iloc[:done]:
            held[own.astype(np.int64, copy=False)] = True
        touched = np.flatnonzero(held)
        return pd.DataFrame({"bucket": np.append(-1, touched).astype(np.int32), "weight": np.append(bias, moved[touched].astype(np.float64)), "n": done})

    return step


#: Buckets of a model whose weights go whole to every task of an epoch: 16 MB.
MOST_DENSE = 1 << 22


def train_hashed(samples: DataFrame, epochs: int = 3, alpha: float = 1e-5, shards: int | None = None, seed: int = 42, rate: float = RATE, max_seconds: float | None = None, **features) -> tuple[DataFrame, float]:
    """(bucket, weight; intercept) of a logistic model over hashed features, by sharded SGD and model averaging.

    Every epoch each shard (a hash of the id) starts from the averaged weights and goes once through its samples in a seeded order (sgd()). Shards'
    weights are averaged over the shards that have the bucket, by rows of it. One shard is plain SGD. A shard must fit a task: unless
    shards is given, there is one for every SHARD samples. After max_seconds no further epoch begins, and within one no shard begins
    a further sample.

    The weights are sent to the tasks as one array and come back, averaged by Spark, for the buckets that were touched: n_features
    bounds both, so there may be MOST_DENSE at most; modq.operators.grouped.train_hashed_profiles() takes more.
    """
    deadline = None if max_seconds is None else time.time() + max_seconds
    n_features = features.get("n_features", FEATURES["n_features"])
    if n_features > MOST_DENSE:
        raise ValueError(f"more than {MOST_DENSE} features")
    zero, one = label_counts(samples)
    intercept, w = math.log((one + 1) / (zero + 1)), np.zeros(n_features, np.float32)
    shards = shards or math.ceil((zero + one) / SHARD)
    keyed = samples.select("id", F.when(F.col("label") == 0, 0.0).otherwise(1.0).alias("y"), "text")
    rows = hashed_vectors(keyed, ["id", "y"], **features).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    data = written(rows, "hashed-samples")
    spark = samples.sparkSession
    for epoch in range(epochs):
        if epoch and deadline is not None and time.time() >= deadline:
            break
        shared = spark.sparkContext.broadcast(w)
        step = _epoch(shared, intercept, rate, alpha, deadline)
        moved = data.withColumn("turn", draw(seed + epoch, "id")).groupBy("shard").applyInPandas(step, "bucket int, weight double, n long").where("n > 0")
        averaged = moved.groupBy("bucket").agg((F.sum(F.col("weight") * F.col("n")) / F.sum("n")).alias("weight")).toPandas()
        bucket, weight = averaged["bucket"].to_numpy(), averaged["weight"].to_numpy()
        if (bucket == -1).any():
            intercept = float(weight[bucket == -1][0])
        w = w.copy()
        w[bucket[bucket >= 0]] = weight[bucket >= 0].astype(np.float32)
        shared.unpersist()
    release(data)
    at = np.flatnonzero(w)
    return spark.createDataFrame(pd.DataFrame({"bucket": at.astype(np.int32), "weight": w[at]}), "bucket int, weight float"), intercept


#: What a hashed model's features depend on, and their defaults: part of its meta.
FEATURES = {"n_features": 1 << 20, "ngrams": (2, 4), "analyzer": "char", "lowercase": True, "norm": "l2", "alternate_sign": True}


def checked_features(settings: dict) -> dict:
    """settings over the defaults of FEATURES; an error if they can't be a model's."""
    if unknown := set(settings) - set(FEATURES):
        raise ValueError(f"unknown feature settings {sorted(unknown)}")
    full = FEATURES | settings
    least, most = full["ngrams"]
    if not 0 < least <= most:
        raise ValueError(f"n-gram range {full['ngrams']}")
    if full["n_features"] < 1 or full["analyzer"] not in ("char", "word") or full["norm"] not in ("l2", None):
        raise ValueError(f"feature settings {full}")
    return full | {"ngrams": (int(least), int(most))}


def write_model(rows: DataFrame, meta: dict, path: str) -> str:
    """Write a model's rows and meta into a new version folder under path, name it the current one, and return it.

    A hashed model's meta may have the settings of FEATURES as features (defaults count), which score_hashed() takes back.
    """
    version = f"{path}/version-{uuid.uuid4().hex}"
    rows.write.parquet(f"{version}/rows")
    spark = rows.sparkSession
    given = meta.get("features") or ({"n_features": meta["n_features"]} if meta.get("n_features") else {})
    features = checked_features(given) if "bucket" in rows.columns else None
    full = {"model_type": "bow", "intercept": 0.0, "classes": [0, 1]} | {k: v for k, v in meta.items() if k not in ("features", "n_features")} | {"runtime_version": 1, "n_rows": rows.count()}
    full |= {"n_features": features["n_features"] if features else None, "features": json.dumps(features) if features else None}
    kinds = {"intercept": "double", "classes": "array<int>", "n_features": "int", "model_type": "string", "features": "string"}
    schema = ", ".join(f"{k} {kinds.get(k, 'bigint')}" for k in full)
    spark.createDataFrame([tuple(full.values())], schema).coalesce(1).write.parquet(f"{version}/meta")
    # a name that sorts last is the current version: written after its rows and meta
    spark.createDataFrame([(version, time.time_ns())], "version string, published bigint").coalesce(1).write.mode("append").parquet(f"{path}/published")
    return version


def current_version(spark: SparkSession, path: str) -> str:
    """The version under path that was published last."""
    return spark.read.parquet(f"{path}/published").agg(F.max_by("version", "published")).first()[0]


def read_model(spark: SparkSession, version: str) -> tuple[DataFrame, dict]:
    """(rows, meta) after checks: runtime version, classes, row count, duplicate or null terms or buckets, weights and idf that are no
    numbers, feature settings, bucket range. meta["features"]: keyword arguments of score_hashed()."""
    meta = spark.read.parquet(f"{version}/meta").first().asDict()
    rows = spark.read.parquet(f"{version}/rows")
    if meta["runtime_version"] != 1:
        raise ValueError(f"runtime version {meta['runtime_version']}")
    if meta["classes"] not in ([0, 1], [1, 0] if meta["model_type"] == "bow" else [0, 1]):
        raise ValueError(f"classes {meta['classes']}")
    key = "bucket" if "bucket" in rows.columns else "term"
    bad = F.col(key).isNull()
    for c in {"weight", "idf"} & set(rows.columns):
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c).cast("double")) == float("inf"))
    n, distinct, broken = rows.agg(F.count("*"), F.count_distinct(key), F.count_if(bad)).first()
    if n != meta["n_rows"] or distinct != n or broken:
        raise ValueError("rows are missing, repeated, empty or no numbers")
    if key == "bucket":
        meta["features"] = checked_features(json.loads(meta["features"]))
        if meta["features"]["n_features"] != meta["n_features"]:
            raise ValueError(f"{meta['n_features']} features, but settings for {meta['features']['n_features']}")
        if rows.where((F.col("bucket") < 0) | (F.col("bucket") >= meta["n_features"])).limit(1).count():
            raise ValueError("a bucket is out of range")
    return rows, meta


def train(samples: DataFrame, path: str, strategy: str = "latest_full", model: str = "bow", max_samples: int = 10_000, max_db_items: int = 100_000, max_features: int = 5000, seed: int = 42, max_seconds: float = 300, **settings) -> tuple[str | None, DataFrame]:
    """Retain, sample, train and write one profile's model: (version folder, a training_runs row).

    settings of a hashed model: epochs, alpha, shards, rate, and those of FEATURES, which are stored with it. Samples that
    can't train a model (a label is missing) give no version and a row of status failed, with the reason.
    """
    from modq.operators import store

    kept, _ = store.retain_balanced(samples, max_db_items, seed)
    sample = store.sampler(strategy)
    chosen = sample(kept, max_samples) if strategy == "latest_full" else sample(kept, max_samples, seed)
    chosen = written(chosen, "training-set")
    version, problem = None, None
    try:
        if model == "hashed":
            features = checked_features({k: v for k, v in settings.items() if k in FEATURES})
            rows, intercept = train_hashed(chosen, seed=seed, max_seconds=max_seconds, **settings | features)
            meta = {"model_type": "hashed", "intercept": intercept, "features": features}
        else:
            rows, intercept = train_terms(chosen, max_features if model == "bow" else max(16, max_samples))
            rows = rows.select("term", F.when(F.lit(model == "bow"), F.col("idf")).otherwise(1.0).alias("idf"), F.col("weight").cast("float").alias("weight"))
            meta = {"model_type": model, "intercept": intercept}
        version = write_model(rows, meta, path)
    except ValueError as e:
        problem = str(e)
    run = samples.select("profile").limit(1).select("profile", F.lit("completed" if version else "failed").alias("status"), F.unix_timestamp(F.current_timestamp()).alias("timestamp"), F.lit(chosen.count()).alias("sample_count"), F.lit(problem).cast("string").alias("reason"))
    return version, run


def training_readiness(profiles: DataFrame, samples: DataFrame, models: DataFrame, runs: DataFrame, now: int, running_hours: int = 2, cooldown_minutes: int = 30) -> DataFrame:
    """profile, ready, reason for each row of profiles (profile, min_samples, retrain_interval_minutes).

    models: profile, trained_at; runs: profile, status, timestamp (seconds). The latest run counts: a
    running one younger than running_hours, or a failed one within the cooldown, skips the profile.
    """
    counts = samples.groupBy("profile").agg(F.count("*").alias("n"))
    newest = models.groupBy("profile").agg(F.max("trained_at").alias("trained_at"))
    last = runs.groupBy("profile").agg(F.max_by("status", "timestamp").alias("status"), F.max("timestamp").alias("ran_at"))
    all_ = profiles.join(counts, "profile", "left").join(newest, "profile", "left").join(last, "profile", "left")
    age = F.lit(now) - F.col("ran_at")
    elapsed = F.lit(now) - F.col("trained_at") > F.col("retrain_interval_minutes") * 60
    reason = (
        F.when((F.col("status") == "running") & (age < running_hours * 3600), "running")
        .when((F.col("status") == "failed") & (age < cooldown_minutes * 60), "cooldown")
        .when(F.coalesce("n", F.lit(0)) < F.col("min_samples"), "insufficient_samples")
        .when(F.col("trained_at").isNull(), "model_missing")
        .when(elapsed, "retrain_interval_elapsed")
        .otherwise("retrain_interval_not_elapsed")
    )
    return all_.select("profile", reason.isin("model_missing", "retrain_interval_elapsed").alias("ready"), reason.alias("reason"))


