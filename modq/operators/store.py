"""The sample store as table operations. samples: profile, id, text, label, category, created_at, text_hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modq.functions.text import text_hash, trimmed
from modq.session import release, written

SCHEMA = "profile string, id bigint, text string, label int, category string, created_at timestamp_ntz, text_hash string"


#: Rows that are taken by a limited sort, which ends in one task.
MOST_SORTED = 10_000


def draw(seed: int, *key: str) -> Column:
    """A seeded hash that orders rows at random, the same in every run."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


def sample_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("profile").agg(F.count("*").alias("total"), F.count_if(F.col("label") == 0).alias("label_0"), F.count_if(F.col("label") != 0).alias("label_1"), (F.max("id") + 1).alias("next_id"))


def latest_by_text(samples: DataFrame) -> DataFrame:
    """The newest sample of each text. Texts are compared themselves, so a hash collision hides none."""
    rest = [c for c in samples.columns if c not in ("profile", "text_hash", "text")]
    best = samples.groupBy("profile", "text_hash", "text").agg(F.max_by(F.struct(*rest), "id").alias("s"))
    return best.select("profile", "text_hash", "text", "s.*")


def import_legacy(legacy: DataFrame, profile: str) -> tuple[DataFrame, DataFrame]:
    """(samples, rejects) from id, text, label, category, created_at (string): nulls get defaults, ids stay, negative ids are rejected."""
    good = legacy.where("id >= 0")
    samples = good.select(
        F.lit(profile).alias("profile"), "id", F.coalesce("text", F.lit("")).alias("text"), F.when(F.coalesce("label", F.lit(0)) == 0, 0).otherwise(1).alias("label"), "category",
        F.to_timestamp_ntz(F.coalesce("created_at", F.lit("1970-01-01 00:00:00"))).alias("created_at"), text_hash(F.coalesce("text", F.lit(""))).alias("text_hash"),
    )
    return samples, legacy.where("id < 0 or id is null").withColumn("reason", F.lit("negative or missing id"))


def append_samples(new: DataFrame, existing: DataFrame, now: Column | None = None) -> DataFrame:
    """new (profile, text, label, category) with ids that go on from each profile's largest, created_at and text_hash.

    Ids need no global sort: rows get a number within their partition, and each (profile, partition) a
    start from the counts; the counts are a row per profile and partition.
    """
    rows = written(new.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "new-samples")
    from pyspark.sql import Window

    within = F.row_number().over(Window.partitionBy("profile", "part").orderBy("at")) - 1
    counts = rows.groupBy("profile", "part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("profile").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("before", before).drop("count").join(existing.groupBy("profile").agg(F.max("id").alias("last")), "profile", "left")
    out = rows.withColumn("within", within).join(starts, ["profile", "part"])
    return out.select(
        "profile", (F.coalesce("last", F.lit(0)) + 1 + F.col("before") + F.col("within")).alias("id"), "text", F.when(F.col("label") == 0, 0).otherwise(1).alias("label"), "category",
        (now if now is not None else F.localtimestamp()).cast("timestamp_ntz").alias("created_at"), text_hash(F.col("text")).alias("text_hash"),
    )


def rebuild_meta(samples: DataFrame) -> DataFrame:
    """profile, name, value: counts and newest-id pointers of each text, recomputed; a missing hash is computed.

    Rows without an id (corrupt records of raw_samples()) count in the total alone.
    """
    sound = samples.where("id is not null").withColumn("text_hash", F.coalesce("text_hash", text_hash(F.col("text"))))
    counts = sample_counts(samples).select("profile", F.explode(F.create_map(F.lit("count"), "total", F.lit("count:0"), "label_0", F.lit("count:1"), "label_1", F.lit("next_id"), F.coalesce("next_id", F.lit(1)))).alias("name", "value"))
    pointers = sound.groupBy("profile", F.concat(F.lit("text_latest:"), "text_hash").alias("name")).agg(F.max("id").alias("value"))
    return counts.unionByName(pointers)


def meta_drift(samples: DataFrame, stored: DataFrame) -> DataFrame:
    """profile, name, stored, rebuilt where the two differ or one is missing; stored: profile, name, value."""
    fresh = rebuild_meta(samples).select(F.col("profile").alias("p"), F.col("name").alias("m"), F.col("value").alias("rebuilt"))
    both = stored.withColumnRenamed("value", "stored").join(fresh, F.col("profile").eqNullSafe(F.col("p")) & (F.col("name") == F.col("m")), "full_outer")
    apart = both.where(~F.col("stored").eqNullSafe(F.col("rebuilt")))
    return apart.select(F.coalesce("profile", "p").alias("profile"), F.coalesce("name", "m").alias("name"), "stored", "rebuilt")


def lookup_by_text(texts: DataFrame, samples: DataFrame) -> DataFrame:
    """texts (profile, text, more) with the newest equal text's sample: hit_id, hit_label, hit_category; nulls without one.

    Of the history only samples with a hash of texts are grouped.
    """
    asked = texts.select("profile", text_hash(F.col("text")).alias("text_hash")).distinct()
    hashed = samples.withColumn("text_hash", F.coalesce("text_hash", text_hash(F.col("text"))))
    newest = latest_by_text(hashed.join(asked, ["profile", "text_hash"], "left_semi")).select("profile", "text_hash", F.col("text").alias("hit_text"), F.col("id").alias("hit_id"), F.col("label").alias("hit_label"), F.col("category").alias("hit_category"))
    keyed = texts.withColumn("text_hash", text_hash(F.col("text")))
    hits = keyed.join(newest, (keyed.profile == newest.profile) & (keyed.text_hash == newest.text_hash) & (keyed.text == newest.hit_text), "left")
    return hits.select(*[keyed[c] for c in texts.columns], "hit_id", "hit_label", "hit_category")


def lookup_by_id(ids: DataFrame, samples: DataFrame) -> DataFrame:
    return samples.join(ids.select("profile", "id").distinct(), ["profile", "id"], "left_semi")


def least(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The n rows that come first by order (any of those that tie for the last place); all if there are fewer.

    Up to MOST_SORTED rows one limited sort takes them. For more, no full row is brought to one task: the light
    sort keys are range-sorted, the cut is found from the ranges' counts, and rows up to it are kept where they are.
    """
    if n <= MOST_SORTED:
        return rows.orderBy(*order).limit(n)
    keys = [f"key{i}" for i in range(len(order))]
    named = lambda columns: F.struct(*[c.alias(k) for c, k in zip(columns, keys, strict=True)])
    light = rows.select(named(order).alias("k")).repartitionByRange("k").sortWithinPartitions("k")
    light = written(light.withColumn("part", F.spark_partition_id()), "keys")
    before = 0
    for r in light.groupBy("part").count().orderBy("part").collect():  # a row for each shuffle partition
        if before + r["count"] < n:
            before += r["count"]
            continue
        own = light.where(F.col("part") == r["part"])
        last = own.orderBy("k").limit(n - before).agg(F.max("k").alias("k")).first()["k"]
        cut = named([F.lit(x) for x in last])
        below = before + own.where(F.col("k") < cut).count()
        release(light)
        return rows.where(named(order) < cut).unionByName(rows.where(named(order) == cut).limit(n - below))
    release(light)
    return rows


def latest_samples(samples: DataFrame, n: int) -> DataFrame:
    return least(samples, n, -F.col("id"))


def random_samples(samples: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows at random without replacement, all if there are fewer: the least by a seeded hash of the id."""
    return least(samples, n, draw(seed, "id"), F.col("id"))


def _labels(samples: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    counts = samples.agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") != 0)).first()
    return samples.where("label = 0"), samples.where("label <> 0"), counts[0], counts[1]


def balanced_undersample(samples: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """min(n0, n1, most / 2) random rows of each label; none if a label has none."""
    zero, one, n0, n1 = _labels(samples)
    k = min(n0, n1, most // 2)
    return random_samples(zero, k, seed).unionByName(random_samples(one, k, seed))


def balanced_latest(samples: DataFrame, most: int) -> DataFrame:
    """Up to most / 2 newest rows of each label."""
    return latest_samples(samples.where("label = 0"), most // 2).unionByName(latest_samples(samples.where("label <> 0"), most // 2))


def balanced_random(samples: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """Up to most / 2 random rows of each label."""
    return random_samples(samples.where("label = 0"), most // 2, seed).unionByName(random_samples(samples.where("label <> 0"), most // 2, seed))


def balanced_oversample(samples: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """min(most / 2, max(n0, n1)) rows of each label, the smaller one repeated evenly; none if a label has none."""
    zero, one, n0, n1 = _labels(samples)
    target = min(most // 2, max(n0, n1)) if n0 and n1 else 0

    def grown(rows: DataFrame, n: int) -> DataFrame:
        if not target or n >= target:
            return random_samples(rows, target, seed)
        whole = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(target // n)))).drop("copy")
        return whole.unionByName(random_samples(rows, target % n, seed))

    return grown(zero, n0).unionByName(grown(one, n1))


def retain_balanced(samples: DataFrame, most: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): at most `most` samples; a label above most / 2 loses its excess at random."""
    zero, one, n0, n1 = _labels(samples)
    if n0 + n1 <= most:
        return samples, samples.limit(0)
    half = most // 2
    kept = (random_samples(zero, half, seed) if n0 > half else zero).unionByName(random_samples(one, half, seed) if n1 > half else one)
    return kept, samples.join(kept.select("profile", "id"), ["profile", "id"], "left_anti")


def pick_sample(samples: DataFrame, label: int, category: str | None = None, seed: int = 42) -> DataFrame:
    """One random row of the distinct non-blank texts of a label (of label 1: and category), with matched_samples."""
    rows = samples.where((F.col("label") != 0) == F.lit(label != 0)).withColumn("plain", trimmed(F.col("text"))).where("plain <> ''")
    if label and category is not None:
        rows = rows.where(F.lower(trimmed(F.col("category"))) == category.strip().lower())
    firsts = rows.groupBy("plain").agg(F.min_by(F.struct(*samples.columns), "id").alias("s")).select("s.*")
    total = firsts.agg(F.count("*").alias("matched_samples"))
    return random_samples(firsts, 1, seed).join(F.broadcast(total))


def sampler(strategy: str, metrics: bool = False):
    """The sampling function of a strategy's name; metrics: of the names that evaluation uses."""
    if metrics:
        return {"latest_full": latest_samples, "random_full": random_samples, "balanced": balanced_random}[strategy]
    return {"latest_full": balanced_latest, "random_full": balanced_random, "random_duplicate": balanced_oversample}.get(strategy, balanced_undersample)


