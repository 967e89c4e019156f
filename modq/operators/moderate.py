"""Keyword rules, term and hashed scores, bands, review and the whole moderation flow."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modq.functions import text as T
from modq.functions.grams import hashed_sums, hashed_vectors
from modq.functions.terms import token_scores
from modq.operators.store import lookup_by_text
from modq.session import written

ERROR_CODE = "BASIC_MODERATION_BLOCKED"
#: Up to so many keywords are looked up one by one; more go through shared 3-grams first.
NESTED_KEYWORDS = 1000
#: Buckets of a model that is sent whole to every task: 16 MB.
MOST_DENSE = 1 << 22
#: Terms of models that are sent whole to every task: about 10 MB.
MOST_TERMS = 200_000
WORD = "struct<pos:bigint,original:string,normalized:string>"


def keyword_block(texts: DataFrame, keywords: DataFrame, error_code: str | Column = ERROR_CODE, by: tuple[str, ...] = ()) -> DataFrame:
    """texts with keyword and keyword_reason: the first keyword in list order that the text holds, ASCII case aside, or null.

    keywords: pos, original, normalized; with by, columns of both tables (the profile), each text meets the list of its own
    alone. Every row of texts is judged by itself, whatever its id. Null text: no keyword. The number of keywords is checked: a list of up to
    NESTED_KEYWORDS is looked up where the text is read, without a shuffle; longer ones meet texts through one 3-gram of each keyword.
    """
    words = keywords.select(*by, F.col("pos").cast("bigint").alias("pos"), "original", "normalized").where("normalized <> ''")
    rows = texts.withColumn("kw_low", T.ascii_lower(F.col("text")))
    if words.limit(NESTED_KEYWORDS + 1).count() <= NESTED_KEYWORDS:
        lists = words.groupBy(*[F.col(c).alias(f"kw_{c}") for c in by]).agg(F.array_sort(F.collect_list(F.struct("pos", "original", "normalized"))).cast(f"array<{WORD}>").alias("kw_asked"), F.min(F.octet_length("normalized")).alias("kw_least"))
        own = F.lit(True)
        for c in by:
            own = own & F.col(c).eqNullSafe(F.col(f"kw_{c}"))
        rows = rows.join(F.broadcast(lists), own, "left")  # no more rows than keywords
    else:
        rows = written(rows.withColumn("kw_row", F.monotonically_increasing_id()), "keyword-texts")
        asked = _candidates(rows, words, by).select(F.col("kw_row").alias("kw_at"), "kw_asked")
        rows = rows.join(asked, F.col("kw_row") == F.col("kw_at"), "left").withColumn("kw_least", F.lit(1))
    # texts that are too short for any keyword needn't be searched
    held = F.filter("kw_asked", lambda w: F.contains(F.col("kw_low"), w.normalized))
    first = F.when(F.octet_length("kw_low") >= F.col("kw_least"), F.try_element_at(held, F.lit(1)).original)
    code = F.lit(error_code) if isinstance(error_code, str) else error_code
    out = rows.withColumn("keyword", first).withColumn("keyword_reason", F.when(F.col("keyword").isNotNull(), F.concat(F.lit("["), code, F.lit("] Matched keyword: "), "keyword")))
    return out.select(*texts.columns, "keyword", "keyword_reason")


def _candidates(rows: DataFrame, words: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """kw_row and kw_asked, the keywords in list order that a text may hold: it has the 3-gram of each that the fewest keywords have.

    Shorter keywords are their own key. A text gets no more keywords than its 3-grams are keys of.
    """
    size = F.least(F.length("normalized"), F.lit(3))
    grams = words.select(*by, "pos", "original", "normalized", F.explode(F.array_distinct(F.when(size == 3, T.char_ngrams(F.col("normalized"), 3, 3)).otherwise(F.array("normalized")))).alias("gram"))
    grams = written(grams, "keyword-grams")
    common = grams.groupBy(*by, "gram").agg(F.count("*").alias("holders"))
    keyed = grams.join(common, [*by, "gram"]).groupBy(*by, "pos", "original", "normalized").agg(F.min_by("gram", F.struct("holders", "gram")).alias("gram"))
    keyed = written(keyed, "keyword-keys")
    least = keyed.agg(F.min(F.length("gram"))).first()[0]
    own = rows.select("kw_row", *by, F.explode(F.array_distinct(T.char_ngrams(F.col("kw_low"), least, 3))).alias("gram"))
    found = own.join(keyed, [*by, "gram"])
    return found.groupBy("kw_row").agg(F.array_sort(F.collect_list(F.struct("pos", "original", "normalized"))).alias("kw_asked"))


def score_terms(texts: DataFrame, terms: DataFrame, intercept: float, tokens: Column | None = None, classes: tuple[int, int] = (0, 1), use_idf: bool = True, key: str = "id") -> DataFrame:
    """key, z, p: intercept plus the sum of count * idf * weight over a text's known tokens, and its sigmoid; a row for each of texts.

    terms: term, idf, weight. tokens: an array column, else white-space tokens. classes (1, 0) turn p round.
    A model of up to MOST_TERMS terms goes to the tasks, and a text's sum is made where the text is read. With more,
    tokens meet the terms in a join; key must then be distinct.
    """
    tokens = T.ws_tokens(F.col("text")) if tokens is None else tokens
    worth = F.col("weight").cast("double") * (F.col("idf") if use_idf else F.lit(1.0))
    known = terms.select("term", worth.alias("weight"))
    few = known.limit(MOST_TERMS + 1).toArrow()
    if few.num_rows <= MOST_TERMS:
        sums = token_scores(texts, tokens, few, keep=[key])
    else:
        found = texts.select(F.col(key).alias("k"), F.explode(tokens).alias("term")).join(known, "term").groupBy("k").agg(F.sum("weight").alias("s"))
        sums = texts.select(key).join(found, F.col(key).eqNullSafe(F.col("k")), "left")
    scored = sums.select(key, (F.lit(float(intercept)) + F.coalesce("s", F.lit(0.0))).alias("z"))
    p = T.sigmoid(F.col("z"))
    return scored.withColumn("p", p if tuple(classes) == (0, 1) else 1 - p)


def score_tokens(texts: DataFrame, terms: DataFrame, intercept: float, tokens: Column | None = None, key: str = "id") -> DataFrame:
    """score_terms without idf: every occurrence of a token adds its weight."""
    return score_terms(texts, terms, intercept, tokens, use_idf=False, key=key)


def hashed_features(texts: DataFrame, key: str = "id", **features) -> DataFrame:
    """key, bucket, value: hashed_vectors()' features of each text, one row each."""
    rows = hashed_vectors(texts, [key], **features)
    return rows.select(key, F.explode(F.arrays_zip("buckets", "values")).alias("x")).select(key, F.col("x.buckets").alias("bucket"), F.col("x.values").alias("value"))


def score_hashed(texts: DataFrame, buckets: DataFrame, intercept: float, key: str = "id", n_features: int = 1 << 20, **features) -> DataFrame:
    """key, z, p from buckets (bucket, weight; absent ones weigh nothing) over the hashed features of each text.

    A model of up to MOST_DENSE buckets goes to the tasks as one array, which bounds it, and a text's sum is made where the text is
    read; with more buckets, features meet their weights in a join.
    """
    if n_features <= MOST_DENSE:
        known = buckets.select("bucket", F.col("weight").cast("float")).toPandas()
        weights = np.zeros(n_features, np.float32)
        weights[known["bucket"].to_numpy(np.int64)] = known["weight"].to_numpy(np.float32)
        sums = hashed_sums(texts, weights, key, n_features, **features)
    else:
        values = hashed_features(texts, key=key, n_features=n_features, **features)
        found = values.join(buckets.select("bucket", "weight"), "bucket").groupBy(F.col(key).alias("k")).agg(F.sum(F.col("weight").cast("double") * F.col("value")).alias("s"))
        sums = texts.select(key).join(found, F.col(key).eqNullSafe(F.col("k")), "left")
    return sums.select(key, (F.lit(float(intercept)) + F.coalesce("s", F.lit(0.0))).alias("z")).withColumn("p", T.sigmoid(F.col("z")))


def decide(scored: DataFrame, low: float | Column = 0.2, high: float | Column = 0.8, source: str | Column = "local") -> DataFrame:
    """scored with decision: p < low allow, p > high block, else uncertain; no p: skipped. And reason."""
    p = F.col("p")
    decision = F.when(p.isNull(), "skipped").when(p < low, "allow").when(p > high, "block").otherwise("uncertain")
    risk = F.when(p < low, "low risk").when(p > high, "high risk").otherwise("uncertain")
    source = F.lit(source) if isinstance(source, str) else source
    return scored.withColumn("decision", decision).withColumn("reason", F.when(p.isNotNull(), F.format_string("%s: %s (p=%.3f)", source, risk, p)))


def unit_draw(seed: int | Column, *key: str) -> Column:
    """A number in [0, 1) from 52 bits of a seeded md5."""
    seed = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.conv(F.left(F.md5(F.concat_ws(":", seed, *[F.col(k).cast("string") for k in key])), F.lit(13)), 16, 10).cast("double") / F.lit(float(1 << 52))


def force_review(rows: DataFrame, rate: float | Column, seed: int | Column = 42, key: str = "id") -> DataFrame:
    """rows with forced: the share `rate` that goes to review before any model; none at 0 or less, all at 1 or more."""
    rate = rate if isinstance(rate, Column) else F.lit(float(rate))
    return rows.withColumn("forced", F.when(rate <= 0, False).when(rate >= 1, True).otherwise(unit_draw(seed, key) < rate))


def capacity_fallback(uncertain: DataFrame, capacity: int, low: float = 0.2, high: float = 0.8, key: str = "id") -> DataFrame:
    """uncertain with route: review for the `capacity` rows nearest the bands' midpoint (ties by key), local_fallback
    for the rest, and violation: of these, whether p is the midpoint or more."""
    middle = (low + high) / 2
    uncertain = written(uncertain, "uncertain")  # its scores are read twice
    stay = uncertain.orderBy(F.abs(F.col("p") - middle), key).limit(capacity).select(F.col(key).alias("stays"))
    out = uncertain.join(stay, F.col(key) == F.col("stays"), "left")
    fallback = F.col("stays").isNull()
    return out.withColumn("route", F.when(fallback, "local_fallback").otherwise("review")).withColumn("violation", F.when(fallback, F.col("p") >= middle)).drop("stays")


def moderate(requests: DataFrame, keywords: DataFrame, scorer: Callable[[DataFrame], DataFrame], history: DataFrame, low: float = 0.2, high: float = 0.8, max_text: int = 4000, review_rate: float = 0.0, seed: int = 42, error_code: str = ERROR_CODE) -> DataFrame:
    """id, profile, text_hash, decision (allow, block, review), source, category, reason, p for requests (id, profile, text).

    Keywords look at the full text. What follows sees the text cut in the middle: each distinct (profile, text) is
    decided once; a drawn share goes to review before the model; scorer(texts) gives id, p for texts (id: a number of its own, profile,
    text); p outside the bands decides; the rest reuse the newest equal sample of history, or go to review.

    Every row of requests gets one decision, also one with a null id or with another's. A null text counts as an empty one; a null profile
    is a profile of its own, without history. modq.operators.profiles has the form with settings and models of each profile.
    """
    settings = {"low": float(low), "high": float(high), "max_text": max_text, "review_rate": float(review_rate), "seed": seed, "error_code": error_code}
    return flow(requests.select("id", "profile", "text", *[F.lit(v).alias(k) for k, v in settings.items()]), keywords, scorer, history)


SETTINGS = ("low", "high", "review_rate", "seed")


def flow(requests: DataFrame, keywords: DataFrame, scorer: Callable[[DataFrame], DataFrame], history: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """moderate() for requests (id, profile, text, low, high, max_text, review_rate, seed, error_code): settings are columns, those of a
    profile's rows the same. by: columns that keywords have, too."""
    rows = requests.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("row", F.monotonically_increasing_id())
    blocked = written(keyword_block(rows, keywords, F.col("error_code"), by).withColumn("text", T.truncate_middle(F.col("text"), F.col("max_text"))).withColumn("text_hash", T.text_hash(F.col("text"))), "keyword-blocks")
    rest = blocked.where("keyword is null")
    distinct = rest.groupBy("profile", "text_hash").agg(F.min_by(F.struct("row", "text", *SETTINGS), "row").alias("r")).select("profile", "text_hash", "r.*")
    distinct = written(force_review(distinct, F.col("review_rate"), F.col("seed"), "text_hash"), "distinct-texts")
    scores = scorer(distinct.where("not forced").select(F.col("row").alias("id"), "profile", "text")).select(F.col("id").alias("scored"), "p")
    scored = decide(distinct.join(scores, F.col("row") == F.col("scored"), "left").drop("scored"), F.col("low"), F.col("high"))
    clear = scored.where("decision in ('allow', 'block')").select("profile", "text_hash", "decision", F.lit("local").alias("source"), F.lit(None).cast("string").alias("category"), "reason", "p")
    open_ = scored.where("decision not in ('allow', 'block')").select("profile", "text", "text_hash", "p")
    found = lookup_by_text(open_, history)
    known = F.col("hit_id").isNotNull()
    settled = found.select(
        "profile", "text_hash", F.when(~known, "review").when(F.col("hit_label") == 0, "allow").otherwise("block").alias("decision"), F.when(known, "history").otherwise("review").alias("source"),
        F.col("hit_category").alias("category"), F.when(known, F.concat(F.lit("history: sample "), F.col("hit_id").cast("string"))).alias("reason"), "p",
    )
    verdicts = clear.unionByName(settled).select(F.col("profile").alias("own"), F.col("text_hash").alias("hash"), "decision", "source", "category", "reason", "p")
    by_model = rest.select("id", "profile", "text_hash").join(verdicts, F.col("profile").eqNullSafe(F.col("own")) & (F.col("text_hash") == F.col("hash"))).drop("own", "hash")
    by_rule = blocked.where("keyword is not null").select("id", "profile", "text_hash", F.lit("block").alias("decision"), F.lit("keyword").alias("source"), F.lit(None).cast("string").alias("category"), F.col("keyword_reason").alias("reason"), F.lit(None).cast("double").alias("p"))
    return by_rule.unionByName(by_model)


def review_queue(decisions: DataFrame, texts: DataFrame, template: str, max_text: int | Column = 4000) -> DataFrame:
    """profile, text_hash, text, prompt: one row per distinct text of texts (profile, text) that waits for review, whatever its id."""
    waiting = decisions.where("decision = 'review'").select(F.col("profile").alias("own"), F.col("text_hash").alias("hash")).distinct()
    cut = texts.select("profile", T.truncate_middle(F.coalesce("text", F.lit("")), max_text).alias("text")).withColumn("text_hash", T.text_hash(F.col("text")))
    held = cut.join(waiting, F.col("profile").eqNullSafe(F.col("own")) & (F.col("text_hash") == F.col("hash")), "left_semi").groupBy("profile", "text_hash").agg(F.min("text").alias("text"))
    return held.select("profile", "text_hash", "text", T.render_prompt(F.lit(template), F.col("text")).alias("prompt"))


def apply_verdicts(queue: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new samples: profile, text, label, category; rejects: profile, text_hash, content, parse_error) from replies (profile, text_hash, content)."""
    read = queue.join(verdicts, ["profile", "text_hash"]).withColumn("v", T.parse_verdict(F.col("content")))
    good = read.where("v.parse_error is null").select("profile", "text", F.when(F.col("v.violation"), 1).otherwise(0).alias("label"), F.col("v.category").alias("category"))
    return good, read.where("v.parse_error is not null").select("profile", "text_hash", "content", F.col("v.parse_error").alias("parse_error"))


def block_message(decisions: DataFrame) -> DataFrame:
    """decisions with message: what a blocked client is told."""
    category = F.when(F.coalesce("category", F.lit("")) != "", F.concat(F.lit(" (category: "), "category", F.lit(")"))).otherwise("")
    confidence = F.when(F.col("p").isNotNull(), F.format_string(" (confidence: %.3f)", F.col("p"))).otherwise("")
    return decisions.withColumn("message", F.when(F.col("decision") == "block", F.concat(F.lit("Smart moderation blocked by "), "source", category, confidence)))


def decision_report(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("profile", "source", "decision").agg(F.count("*").alias("n"))
