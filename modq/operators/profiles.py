"""Moderation of many profiles in one plan: settings, keywords and models are tables keyed by profile."""

from __future__ import annotations

import json
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modq.functions import text as T
from modq.functions.grams import hashed, plain_text, slices
from modq.functions.terms import BETWEEN, token_scores
from modq.operators import moderate as M
from modq.operators.train import FEATURES, checked_features
from modq.session import written

#: Settings of a profile and their defaults, for profiles without a row and null settings.
DEFAULTS = {"low": 0.2, "high": 0.8, "max_text": 4000, "review_rate": 0.3, "seed": 42, "error_code": M.ERROR_CODE}
TYPES = {"low": "double", "high": "double", "max_text": "int", "review_rate": "double", "seed": "bigint", "error_code": "string"}
#: Bytes of text that meet a hashed model in one task, about; a profile with more is cut in shards.
SHARD_BYTES = 32 << 20


class Catalog(NamedTuple):
    """models: profile, model_type (bow, fasttext or hashed), intercept, reversed (bow's classes are [1, 0]), features (JSON, of hashed models).
    terms: profile, term, idf, weight. buckets: profile, bucket, weight. A profile without a model's row has none."""

    models: DataFrame
    terms: DataFrame
    buckets: DataFrame


def with_settings(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """rows with the columns of DEFAULTS, from profiles (profile and some of them; a profile's settings stand in one row).

    profiles is written first: a table of a size that Spark knows goes to rows' tasks, and rows aren't dealt by profile, which would bring each
    profile's texts to one task. Rows of more profiles than may be sent are dealt, and Spark cuts partitions that are too large.
    """
    given = [c for c in DEFAULTS if c in profiles.columns]
    own = written(profiles.select(F.col("profile").alias("own_profile"), *[F.col(c).cast(TYPES[c]).alias(f"own_{c}") for c in given]), "settings")
    joined = rows.join(own, F.col("profile") == F.col("own_profile"), "left")
    setting = lambda c: F.coalesce(*([F.col(f"own_{c}")] if c in given else []), F.lit(DEFAULTS[c]).cast(TYPES[c]))
    return joined.select(*[rows[c] for c in rows.columns if c not in DEFAULTS], *[setting(c).alias(c) for c in DEFAULTS])


def score_term_profiles(texts: DataFrame, catalog: Catalog, key: str = "id") -> DataFrame:
    """key and s of texts (key, profile, text): the sum of count * idf * weight over a text's tokens, under its profile's own term model.

    All models of up to MOST_TERMS terms together go to the tasks. More meet the tokens in one join on (profile, term); the
    tokens of a text are counted first. key must be distinct.
    """
    kinds = catalog.models.where("model_type <> 'hashed'").select("profile", "model_type")
    worth = F.col("weight").cast("double") * F.when(F.col("model_type") == "bow", F.col("idf")).otherwise(1.0)
    known = catalog.terms.join(kinds, "profile").select("profile", "term", worth.alias("weight"))
    tokens = T.ws_tokens(F.col("text"))
    few = known.select(F.concat("profile", F.lit(BETWEEN), "term").alias("term"), "weight").limit(M.MOST_TERMS + 1).toArrow()
    if few.num_rows <= M.MOST_TERMS:
        return token_scores(texts, tokens, few, "profile", [key])
    each = texts.select(F.col(key).alias("k"), "profile", F.explode(tokens).alias("term")).groupBy("k", "profile", "term").agg(F.count("*").alias("n"))
    found = each.join(known, ["profile", "term"]).groupBy("k").agg(F.sum(F.col("n") * F.col("weight")).alias("s"))
    return texts.select(key).join(found, F.col(key) == F.col("k"), "left").select(key, F.coalesce("s", F.lit(0.0)).alias("s"))


def score_hashed_profiles(texts: DataFrame, catalog: Catalog, key: str = "id") -> DataFrame:
    """key and s of texts (key, profile, text): each text's hashed features times the weights of its profile's model, with that model's own feature settings.

    Texts are dealt by profile and meet its weights in one co-grouped pass: a text is moved once, its n-grams never. A profile with more
    than SHARD_BYTES of text is cut in shards, each with a copy of its weights. Texts whose profile has no hashed model give no row.
    """
    models = catalog.models.where("model_type = 'hashed'").select("profile", "features")
    sizes = texts.groupBy("profile").agg(F.ceil(F.sum(F.octet_length("text")) / SHARD_BYTES).alias("shards"))
    models = models.join(sizes, "profile").select(F.col("profile").alias("owner"), "features", F.greatest(F.col("shards"), F.lit(1)).alias("shards"))
    models = written(models, "hashed-models")  # a row for each profile, of a size that Spark knows
    settings = F.from_json("features", "struct<lowercase:boolean,analyzer:string>")
    words, lowered = settings["analyzer"] == "word", F.coalesce(settings["lowercase"], F.lit(True))
    rows = texts.join(models, F.col("profile") == F.col("owner"))
    plain = F.when(words & lowered, plain_text(True, True)).when(words, plain_text(False, True)).when(lowered, plain_text(True, False)).otherwise(plain_text(False, False))
    rows = rows.select(F.col(key).alias("k"), "profile", F.pmod(F.xxhash64(key), F.col("shards")).alias("shard"), "features", plain.alias("plain"))
    copies = models.select("owner", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("at"))
    weights = catalog.buckets.join(copies, F.col("profile") == F.col("owner")).select("owner", "at", "bucket", F.col("weight").cast("float").alias("weight"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        names, parts = pa.schema([left.schema.field("k"), ("s", pa.float64())]), []
        if not left.num_rows:  # weights of a shard without texts
            return names.empty_table()
        made = checked_features(json.loads(left.column("features")[0].as_py() or "{}"))
        dense = np.zeros(made["n_features"], np.float32)
        dense[right.column("bucket").to_numpy()] = right.column("weight").to_numpy()
        for batch in left.to_batches():
            for first, end, data, offs in slices(batch.column("plain")):
                text, bucket, value = hashed(data, offs, made["ngrams"], made["analyzer"] != "char", made["n_features"], made["norm"], made["alternate_sign"])
                sums = np.bincount(text, dense[bucket].astype(np.float64) * value, minlength=end - first).astype(np.float64)
                parts.append(pa.record_batch([batch.column("k").slice(first, end - first), pa.array(sums)], schema=names))
        return pa.Table.from_batches(parts, names)

    out = rows.groupBy("profile", "shard").cogroup(weights.groupBy("owner", "at")).applyInArrow(score, f"k {dict(rows.dtypes)['k']}, s double")
    return out.select(F.col("k").alias(key), "s")


def score_profiles(texts: DataFrame, catalog: Catalog, key: str = "id") -> DataFrame:
    """key, z, p for texts (key, profile, text) under the models of their own profiles; null where a profile has none. key must be distinct.

    One plan, whatever the number of profiles: rows of term models are summed in score_term_profiles(), rows of hashed models in
    score_hashed_profiles(). p of a reversed model is 1 - sigmoid(z).
    """
    models = written(catalog.models.select(F.col("profile").alias("model_profile"), "model_type", F.col("intercept").cast("double").alias("intercept"), F.coalesce("reversed", F.lit(False)).alias("reversed")), "models")
    rows = texts.join(models, F.col("profile") == F.col("model_profile"), "left").drop("model_profile")
    by_terms = score_term_profiles(rows.where("model_type <> 'hashed'"), catalog, key)
    by_hash = score_hashed_profiles(rows.where("model_type = 'hashed'").select(*texts.columns), catalog, key)
    sums = by_terms.unionByName(by_hash).select(F.col(key).alias("summed"), "s")
    z = F.when(F.col("intercept").isNotNull(), F.col("intercept") + F.coalesce("s", F.lit(0.0)))
    scored = rows.join(sums, F.col(key) == F.col("summed"), "left").select(key, z.alias("z"), "reversed")
    return scored.select(key, "z", F.when(F.col("reversed"), 1 - T.sigmoid(F.col("z"))).otherwise(T.sigmoid(F.col("z"))).alias("p"))


def moderate_profiles(requests: DataFrame, profiles: DataFrame, keywords: DataFrame, catalog: Catalog, history: DataFrame) -> DataFrame:
    """moderate() for requests (id, profile, text) of any number of profiles at once: each row under the settings, the keywords and the
    model of its own profile, in one plan.

    profiles: profile and some of DEFAULTS, which count for a profile without a row and for null settings. keywords: profile, pos, original,
    normalized. A profile without a model (or a null one): what its keywords don't block goes to history, then review.
    """
    return M.flow(with_settings(requests.select("id", "profile", "text"), profiles), keywords, lambda texts: score_profiles(texts, catalog), history, ("profile",))


def review_queue_profiles(decisions: DataFrame, requests: DataFrame, profiles: DataFrame, template: str) -> DataFrame:
    """review_queue() with each profile's own max_text."""
    rows = with_settings(requests.select("profile", "text"), profiles)
    return M.review_queue(decisions, rows, template, F.col("max_text"))


def features_json(**settings) -> str:
    """The features column of a hashed model with these settings over the defaults."""
    return json.dumps(checked_features(settings))


def midpoint(low: Column, high: Column) -> Column:
    return (low + high) / 2


def capacity_fallback_profiles(uncertain: DataFrame, profiles: DataFrame, key: str = "id") -> DataFrame:
    """capacity_fallback() of many profiles: uncertain (key, profile, p) with route and violation; profiles: profile, capacity and settings. Of each profile,
    the `capacity` rows nearest its own midpoint stay in review (ties by key), whatever number of rows it has."""
    from modq.operators.grouped import least_of_each

    rows = with_settings(uncertain.select(*[c for c in uncertain.columns if c not in DEFAULTS]), profiles)
    middle = midpoint(F.col("low"), F.col("high"))
    # distances lie between 0 and 1: their bits order as longs do
    rows = written(rows.withColumn("far", F.abs(F.col("p") - middle)).withColumn("violates", F.col("p") >= middle), "uncertain")
    room = profiles.select("profile", F.coalesce(F.col("capacity"), F.lit(0)).cast("bigint").alias("n"))
    stay = least_of_each(rows, ["profile"], room, [(F.col("far") * F.lit(float(1 << 60))).cast("bigint")], [F.col("far"), F.col(key)])
    stays = stay.select(F.col("profile").alias("stay_profile"), F.col(key).alias("stays"))
    out = rows.join(stays, (F.col(key) == F.col("stays")) & (F.col("profile") == F.col("stay_profile")), "left")
    fallback = F.col("stays").isNull()
    return out.select(*uncertain.columns, F.when(fallback, "local_fallback").otherwise("review").alias("route"), F.when(fallback, F.col("violates")).alias("violation"))


__all__ = ["DEFAULTS", "FEATURES", "Catalog", "capacity_fallback_profiles", "features_json", "moderate_profiles", "review_queue_profiles", "score_hashed_profiles", "score_profiles", "score_term_profiles", "with_settings"]
