"""Selection, training and moderation of many profiles at once against one profile at a time, and against plain versions."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from modq.operators import grouped, moderate, profiles, store, train

SCHEMA = "profile string, id long, text string, label int, category string"
WORDS = ["calm", "rain", "stone", "river", "green", "loud", "angry", "threat", "cloud", "paper"]


@pytest.fixture(scope="module")
def many(spark):
    """40 small profiles, one with a third of all samples, one of a single label."""
    rng, rows = random.Random(3), []
    for p in range(40):
        rows += [(f"p{p}", i, " ".join(rng.choices(WORDS, k=6)), int(rng.random() < 0.3), None) for i in range(rng.randint(1, 40))]
    rows += [("big", i, " ".join(rng.choices(WORDS, k=6)), int(i % 4 == 0), None) for i in range(500)]
    rows += [("one", i, "calm rain", 0, None) for i in range(30)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def by_profile(df, *cols):
    out = defaultdict(list)
    for r in df.select("profile", *cols).collect():
        out[r["profile"]].append(tuple(r)[1:])
    return {p: sorted(v) for p, v in out.items()}


@pytest.mark.parametrize("few, bins", [(10_000, 1024), (3, 4)])
def test_least_of_each(spark, many, monkeypatch, few, bins):
    """Rounds of few bins and large ties find the same rows as a sort of each group."""
    monkeypatch.setattr(grouped, "FEW", few)
    monkeypatch.setattr(grouped, "BINS", bins)
    rows = many.withColumn("a", F.col("id") % 3).withColumn("b", F.length("text"))
    n = spark.createDataFrame([(f"p{p}", p % 7) for p in range(39)] + [("big", 111), ("one", 500)], "profile string, n long")
    got = by_profile(grouped.least_of_each(rows, ["profile"], n, [F.col("a"), F.col("b")], [F.col("id")]), "a", "b", "id")
    wanted, limits = by_profile(rows, "a", "b", "id"), {r["profile"]: r["n"] for r in n.collect()}
    assert got == {p: v[: limits[p]] for p, v in wanted.items() if limits.get(p)}


def test_samplers_by_profile(spark, many):
    """Each profile's samples are those that the one-profile functions take."""
    strategies = ["latest_full", "random_full", "random_duplicate", "balanced_undersample"]
    names = [f"p{p}" for p in range(0, 40, 9)] + ["big", "one"]
    for shift in range(4):
        limits = spark.createDataFrame([(p, 21 + 30 * (p == "big"), strategies[(i + shift) % 4]) for i, p in enumerate(names)], "profile string, most int, strategy string")
        got = by_profile(grouped.balanced_samples(many, limits, 7), "id", "label")
        for r in limits.collect():
            own = many.where(F.col("profile") == r["profile"])
            sample = store.sampler(r["strategy"])
            want = sample(own, r["most"]) if r["strategy"] == "latest_full" else sample(own, r["most"], 7)
            assert got.get(r["profile"], []) == by_profile(want, "id", "label").get(r["profile"], []), r
        assert set(got) <= set(names)


def test_retain_by_profile(spark, many):
    limits = spark.createDataFrame([("big", 60), ("one", 10), ("p3", 10_000)], "profile string, most int")
    kept, removed = grouped.retain_profiles(many, limits, 7)
    kept, removed = by_profile(kept, "id", "label"), by_profile(removed, "id", "label")
    whole = by_profile(many, "id", "label")
    assert {p: sorted(kept.get(p, []) + removed.get(p, [])) for p in whole} == whole and set(removed) == {"big", "one"}
    for p, most in (("big", 60), ("one", 10)):
        assert kept[p] == by_profile(store.retain_balanced(many.where(F.col("profile") == p), most, 7)[0], "id", "label")[p]


def test_terms_by_profile(spark, many, monkeypatch):
    monkeypatch.setattr(grouped, "FEW", 2)
    limits = many.select("profile").distinct().withColumn("max_features", F.lit(6))
    terms, models = grouped.train_terms_profiles(many, limits)
    got, biases = by_profile(terms, "term", "pass_hits", "violation_hits", "df", "idf", "weight"), {r["profile"]: r["intercept"] for r in models.collect()}
    labels = by_profile(many, "label")
    trained = {p for p, v in labels.items() if len(set(v)) == 2}
    assert set(got) == set(biases) == trained and "one" not in trained
    for p in ["big", *sorted(trained)[:4]]:
        want, bias = train.train_terms(many.where(F.col("profile") == p), 6)
        assert got[p] == by_profile(want.withColumn("profile", F.lit(p)), "term", "pass_hits", "violation_hits", "df", "idf", "weight")[p] and biases[p] == pytest.approx(bias, abs=1e-12)


def plain_sgd(rows, n_features, epochs, alpha, rate, seed):
    """Plain SGD over rows (id, y, buckets, values), weights in 32-bit floats."""
    ones = sum(y for _, y, _, _ in rows)
    w, bias = np.zeros(n_features, np.float32), math.log((ones + 1) / (len(rows) - ones + 1))
    import hashlib

    for epoch in range(epochs):
        for i, y, buckets, values in sorted(rows, key=lambda r: (hashlib.md5(f"{seed + epoch}:{r[0]}".encode()).hexdigest(), r[0])):
            z = bias + sum(float(w[b]) * v for b, v in zip(buckets, values, strict=True))
            error = y - (1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z)))
            bias += rate * error
            for b, v in zip(buckets, values, strict=True):
                w[b] = np.float32(w[b] + np.float32(rate * (error * v - float(np.float32(alpha)) * float(w[b]))))
    return w, bias


def test_hashed_training_is_plain_sgd(spark, many):
    """One shard: the rule itself. Several: the mean of their weights by rows, over the shards that have a bucket."""
    from modq.functions.grams import hashed_vectors

    own = many.where("profile = 'big' and id < 60")
    vectors = [(r["id"], r["label"], r["buckets"], r["values"]) for r in hashed_vectors(own, ["id", "label"], n_features=512).collect()]
    got, bias = train.train_hashed(own, epochs=2, shards=1, n_features=512)
    w, plain_bias = plain_sgd(vectors, 512, 2, 1e-5, train.RATE, 42)
    assert bias == pytest.approx(plain_bias, abs=1e-9)
    found = {r["bucket"]: r["weight"] for r in got.collect()}
    assert set(found) == set(np.flatnonzero(w)) and all(abs(found[b] - w[b]) < 1e-6 for b in found)
    shard = {r["id"]: r["s"] for r in own.select("id", F.pmod(F.xxhash64("id"), F.lit(3)).alias("s")).collect()}
    got, bias = train.train_hashed(own, epochs=1, shards=3, n_features=512)
    found, total, weighed, biases = {r["bucket"]: r["weight"] for r in got.collect()}, np.zeros(512), np.zeros(512), 0.0
    ones = sum(y for _, y, _, _ in vectors)
    for s in range(3):
        rows = [v for v in vectors if shard[v[0]] == s]
        import pandas as pd

        frame = pd.DataFrame([(i, float(y), np.array(b), np.array(v)) for i, y, b, v in sorted(rows, key=lambda r: (__import__("hashlib").md5(f"42:{r[0]}".encode()).hexdigest(), r[0]))], columns=["id", "y", "buckets", "values"])
        part, b, _ = train.sgd(frame, None, np.zeros(512, np.float32), math.log((ones + 1) / (len(vectors) - ones + 1)), train.RATE, 1e-5)
        touched = sorted({x for _, _, bs, _ in rows for x in bs})
        total[touched] += part[touched].astype(float) * len(rows)
        weighed[touched] += len(rows)
        biases += b * len(rows)
    assert bias == pytest.approx(biases / len(vectors), abs=1e-9)
    assert all(abs(found.get(b, 0.0) - total[b] / weighed[b]) < 1e-6 for b in np.flatnonzero(weighed))


def test_time_cap_inside_an_epoch(spark, many):
    rows, bias = train.train_hashed(many.where("profile = 'big'"), epochs=5, n_features=512, max_seconds=0)
    ones, n = many.where("profile = 'big' and label = 1").count(), 500
    assert rows.count() == 0 and bias == pytest.approx(math.log((ones + 1) / (n - ones + 1)))


def test_hashed_by_profile(spark, many):
    some = many.where("profile in ('big', 'p3', 'p4', 'one')")
    buckets, models = grouped.train_hashed_profiles(some, epochs=2, shard=200, n_features=512, ngrams=(1, 2))
    got = {p: dict(v) for p, v in by_profile(buckets, "bucket", "weight").items()}
    biases = {r["profile"]: r["intercept"] for r in models.collect()}
    assert "one" not in biases and set(got) == set(biases)
    for p in biases:
        own = some.where(F.col("profile") == p)
        want, bias = train.train_hashed(own, epochs=2, shards=math.ceil(own.count() / 200), n_features=512, ngrams=(1, 2))
        want = {r["bucket"]: r["weight"] for r in want.collect()}
        assert biases[p] == pytest.approx(bias, abs=1e-6) and all(abs(got[p].get(b, 0) - want.get(b, 0)) < 1e-6 for b in set(want) | set(got[p]))


@pytest.fixture(scope="module")
def catalog(spark, many):
    """Term models for most profiles, one reversed, one without idf, hashed models for two."""
    terms, models = grouped.train_terms_profiles(many.where("profile not in ('p3', 'p4')"), many.select("profile").distinct().withColumn("max_features", F.lit(6)))
    buckets, hashed = grouped.train_hashed_profiles(many.where("profile in ('p3', 'p4')"), epochs=1, n_features=512, ngrams=(1, 3))
    models = models.withColumn("reversed", F.col("profile") == "p5").withColumn("model_type", F.when(F.col("profile") == "p6", "fasttext").otherwise(F.col("model_type")))
    return profiles.Catalog(models.unionByName(hashed), terms, buckets)


def test_scores_by_profile(spark, many, catalog, monkeypatch):
    texts = many.select((F.monotonically_increasing_id() + 7).alias("id"), "profile", "text").unionByName(spark.createDataFrame([(-1, "none", "calm"), (-2, None, "calm"), (-3, "p3", ""), (-4, "big", "")], "id long, profile string, text string"))
    from modq.session import written

    texts = written(texts, "texts")
    got = {r["id"]: (r["z"], r["p"]) for r in profiles.score_profiles(texts, catalog).collect()}
    assert len(got) == texts.count() and got[-1] == got[-2] == (None, None)
    models = {r["profile"]: r for r in catalog.models.collect()}
    for p in ("big", "p3", "p4", "p5", "p6"):
        m, own = models[p], texts.where(F.col("profile") == p)
        if m["model_type"] == "hashed":
            want = moderate.score_hashed(own, catalog.buckets.where(F.col("profile") == p), m["intercept"], n_features=512, ngrams=(1, 3))
        else:
            want = moderate.score_terms(own, catalog.terms.where(F.col("profile") == p), m["intercept"], classes=(1, 0) if m["reversed"] else (0, 1), use_idf=m["model_type"] == "bow")
        for r in want.collect():
            assert got[r["id"]] == (pytest.approx(r["z"], abs=1e-9), pytest.approx(r["p"], abs=1e-9))
    monkeypatch.setattr(moderate, "MOST_TERMS", 3)
    monkeypatch.setattr(profiles, "SHARD_BYTES", 500)
    joined = {r["id"]: r["z"] for r in profiles.score_profiles(texts, catalog).collect()}
    assert joined.keys() == got.keys() and all(z == pytest.approx(got[i][0], abs=1e-9) for i, z in joined.items())


def test_every_request_gets_one_decision(spark, many):
    """Null ids, ids that profiles or rows share, null texts and profiles; a keyword blocks its own row alone."""
    words = spark.createDataFrame([(1, "Needle", "needle")], "pos int, original string, normalized string")
    rows = [(None, "a", "a needle"), (None, "a", "fine words"), (None, "a", "fine words"), (1, "a", "NEEDLE"), (1, "b", "fine words"), (1, "b", "more words"), (None, None, "x"), (2, "a", None), (2, None, "needle")]
    requests = spark.createDataFrame(rows, "id long, profile string, text string")
    scorer = lambda t: t.select("id", F.when(F.col("text") == "fine words", 0.1).otherwise(0.5).alias("p"))
    decided = moderate.moderate(requests, words, scorer, many.withColumn("text_hash", F.md5("text")))
    got = sorted(((r["id"], r["profile"], r["text_hash"], r["decision"], r["source"]) for r in decided.collect()), key=str)
    import hashlib

    want = []
    for i, p, t in rows:
        t = t or ""
        word = "needle" in t.lower()
        want.append((i, p, hashlib.md5(t.encode()).hexdigest(), "block" if word else "allow" if t == "fine words" else "review", "keyword" if word else "local" if t == "fine words" else "review"))
    assert got == sorted(want, key=str)
    queue = moderate.review_queue(decided, requests, "<{{text}}>")
    assert sorted(((r["profile"], r["prompt"]) for r in queue.collect()), key=str) == sorted([("b", "<more words>"), (None, "<x>"), ("a", "<>")], key=str)


def test_long_keyword_lists(spark, monkeypatch):
    """The 3-gram way gives what the short way gives: shared beginnings, keywords of one or two characters, lists by profile, null ids."""
    rng = random.Random(5)
    words = [("".join(rng.choices("abé", k=rng.randint(1, 6))), rng.choice("pq")) for _ in range(200)]
    keywords = spark.createDataFrame([(p, i, w.title(), w) for i, (w, p) in enumerate(words)], "profile string, pos int, original string, normalized string")
    texts = spark.createDataFrame([(None, rng.choice(["p", "q", None]), "".join(rng.choices("ABCabcxyzÉé", k=rng.randint(0, 30)))) for _ in range(150)], "id long, profile string, text string")
    texts = texts.withColumn("code", F.concat(F.lit("C-"), "profile"))
    for by in ((), ("profile",)):
        seen = lambda: sorted((tuple(r) for r in moderate.keyword_block(texts, keywords if by else keywords.drop("profile"), F.col("code"), by).collect()), key=str)
        short = seen()
        want = []
        for r in texts.collect():
            low = "".join(c.lower() if c.isascii() else c for c in r["text"])
            hit = next((w.title() for w, p in words if (not by or p == r["profile"]) and w in low), None)
            want.append((r["id"], r["profile"], r["text"], r["code"], hit, None if hit is None or r["code"] is None else f"[{r['code']}] Matched keyword: {hit}"))
        assert short == sorted(want, key=str)
        monkeypatch.setattr(moderate, "NESTED_KEYWORDS", 10)
        assert seen() == short
        monkeypatch.undo()


def test_moderate_profiles(spark, many, catalog):
    """One plan over all profiles decides as one call for each would, with its settings, keywords and model."""
    settings = {"big": (0.3, 0.6, 12, 0.0, 1, "BIG"), "p3": (0.49, 0.51, 4000, 0.5, 9, "T3"), "p5": (0.1, 0.9, 4000, 1.0, 2, None)}
    table = spark.createDataFrame([(p, *v) for p, v in settings.items()], "profile string, low double, high double, max_text int, review_rate double, seed long, error_code string")
    keywords = spark.createDataFrame([("big", 1, "Stone", "stone"), ("p3", 1, "River", "river"), ("p3", 2, "calm", "calm")], "profile string, pos int, original string, normalized string")
    requests = many.select((F.col("id") % 3).alias("id"), "profile", "text")
    history = many.where("id % 2 = 0").withColumn("text_hash", F.md5("text"))
    decided = profiles.moderate_profiles(requests, table, keywords, catalog, history)
    got = by_profile(decided, "id", "text_hash", "decision", "source", F.coalesce("reason", F.lit("")).alias("reason"))
    assert sum(map(len, got.values())) == many.count()
    for p in ("big", "p3", "p5", "one", "p9"):
        low, high, most, rate, seed, code = settings.get(p, (0.2, 0.8, 4000, 0.3, 42, None))
        scorer = lambda t, p=p: profiles.score_profiles(t.withColumn("profile", F.lit(p)), catalog)
        want = moderate.moderate(requests.where(F.col("profile") == p), keywords.where(F.col("profile") == p), scorer, history, low, high, most, rate, seed, code or moderate.ERROR_CODE)
        assert got[p] == by_profile(want, "id", "text_hash", "decision", "source", F.coalesce("reason", F.lit("")).alias("reason"))[p], p
    queue = profiles.review_queue_profiles(decided, requests, table, "{{text}}")
    waiting = {(p, h) for p, v in got.items() for _, h, d, _, _ in v if d == "review"}
    assert {(r["profile"], r["text_hash"]) for r in queue.collect()} == waiting


def test_capacity_by_profile(spark):
    rows = spark.createDataFrame([(p, i, i / 40) for p in "ab" for i in range(8, 33)], "profile string, id long, p double")
    table = spark.createDataFrame([("a", 3, 0.2, 0.8), ("b", 5, 0.0, 0.6)], "profile string, capacity int, low double, high double")
    got = profiles.capacity_fallback_profiles(rows, table).collect()
    for p, capacity, low, high in (("a", 3, 0.2, 0.8), ("b", 5, 0.0, 0.6)):
        want = moderate.capacity_fallback(rows.where(F.col("profile") == p), capacity, low, high).collect()
        assert sorted(map(tuple, want), key=str) == sorted((tuple(r) for r in got if r["profile"] == p), key=str)
