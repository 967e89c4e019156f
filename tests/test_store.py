import datetime
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from modq.operators import evaluate, store, train


def samples(spark, rows):
    at = datetime.datetime(2026, 4, 3, 10)
    return spark.createDataFrame([("p", i, t, y, None, at) for i, t, y in rows], "profile string, id long, text string, label int, category string, created_at timestamp_ntz").withColumn("text_hash", F.md5("text"))


@pytest.fixture(scope="module")
def six(spark):
    return samples(spark, [(1, "pass-1", 0), (2, "pass-2", 0), (3, "violation-1", 1), (4, "pass-3", 0), (5, "violation-2", 1), (6, "violation-3", 1)])


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_samplers(spark, six):
    assert ids(store.balanced_latest(six, 4)) == [2, 4, 5, 6]
    few = samples(spark, [(1, "a", 0), (2, "b", 0), (3, "c", 0), (4, "d", 1)])
    grown = store.balanced_oversample(few, 4).collect()
    assert sorted(r["label"] for r in grown) == [0, 0, 1, 1] and all(r["id"] == 4 for r in grown if r["label"])
    assert sorted(r["label"] for r in store.balanced_undersample(few, 6).collect()) == [0, 1]
    for f in (store.balanced_latest, store.balanced_random, store.balanced_oversample, store.balanced_undersample):
        assert f(six, 1).count() == 0


def test_retain_and_lookup(spark):
    s = samples(spark, [(1, "b", 1), (2, "b", 1), (3, "b", 1), (4, "pass-1", 0), (5, "pass-2", 0)])
    kept, removed = store.retain_balanced(s, 4)
    assert kept.count() == 4 and removed.count() == 1 and kept.unionByName(removed).count() == 5
    asked = spark.createDataFrame([("p", "b"), ("p", "none")], "profile string, text string")
    hits = {r["text"]: r["hit_id"] for r in store.lookup_by_text(asked, s).collect()}
    assert hits == {"b": 3, "none": None}


def test_append_continues_ids(spark, six):
    new = spark.createDataFrame([("p", f"t{i}", 5, None) for i in range(9)], "profile string, text string, label int, category string").repartition(3)
    out = store.append_samples(new, six)
    assert ids(out) == list(range(7, 16)) and {r["label"] for r in out.collect()} == {1}


def test_import_and_drift(spark, six):
    old = spark.createDataFrame([(1, None, None, None, None), (-2, "x", 0, None, None)], "id long, text string, label long, category string, created_at string")
    good, bad = store.import_legacy(old, "p")
    assert good.first()["label"] == 0 and str(good.first()["created_at"]) == "1970-01-01 00:00:00" and bad.count() == 1
    assert store.meta_drift(six, store.rebuild_meta(six)).count() == 0


MAIL = [(1, "see you at lunch", 0), (2, "lunch was great", 0), (3, "you foul foul thing", 1), (4, "great foul mouth", 1), (5, "see the dentist", 0)]


def plain_model(rows):
    """{term: (weight, idf)}, intercept of (id, text, label) rows, worked out by hand."""
    hits, held, labels = Counter(), Counter(), Counter()
    for _, text, label in rows:
        labels[label] += 1
        held.update(set(text.split()))
        hits.update((t, label) for t in text.split())
    n = len(rows)
    return {t: (math.log((hits[t, 1] + 1) / (hits[t, 0] + 1)), math.log((n + 1) / (held[t] + 1)) + 1) for t in held}, math.log((labels[1] + 1) / (labels[0] + 1))


def test_train_and_score_terms(spark):
    from modq.operators import moderate

    s = samples(spark, MAIL)
    terms, intercept = train.train_terms(s, 100)
    model, bias = plain_model(MAIL)
    assert intercept == pytest.approx(bias) and terms.first()["term"] == "foul"
    assert {r["term"]: (pytest.approx(r["weight"]), pytest.approx(r["idf"])) for r in terms.collect()} == model
    texts = {1: "foul lunch", 2: "see you at the dentist", 3: "foul foul great", 4: "nobody"}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    for score, idf in ((moderate.score_terms, True), (moderate.score_tokens, False)):
        got = {r["id"]: r["p"] for r in score(df, terms, intercept).collect()}
        for i, text in texts.items():
            z = bias + sum(w * (f if idf else 1) for w, f in (model.get(t, (0, 0)) for t in text.split()))
            assert got[i] == pytest.approx(1 / (1 + math.exp(-z)))
    with pytest.raises(ValueError):
        train.train_terms(s.where("label = 0"), 10)


def test_model_round_trip(spark, tmp_path):
    s = samples(spark, MAIL[1:])
    version, run = train.train(s, str(tmp_path), max_samples=4)
    rows, meta = train.read_model(spark, version)
    assert rows.count() == len({w for _, t, _ in MAIL[1:] for w in t.split()}) and meta["runtime_version"] == 1 and run.first()["sample_count"] == 4


def test_hashed_training_separates(spark):
    from modq.operators import moderate

    s = samples(spark, [(i, "lunch was great" if i % 2 else "you foul thing", 1 - i % 2) for i in range(20)])
    weights, intercept = train.train_hashed(s, epochs=2, shards=1, n_features=1 << 12)
    p = {r["id"]: r["p"] for r in moderate.score_hashed(s.select("id", "text"), weights, intercept, n_features=1 << 12).collect()}
    assert p[0] > 0.5 > p[1]
    two, _ = train.train_hashed(s, epochs=2, shards=2, n_features=1 << 12)
    assert two.count() == weights.count()


def test_hashed_score_of_one_bucket(spark):
    from modq.operators import moderate

    texts = spark.createDataFrame([(1, "some text"), (2, "x")], "id long, text string")
    buckets = spark.createDataFrame([(0, 10.0)], "bucket int, weight float")
    p = {r["id"]: r["p"] for r in moderate.score_hashed(texts, buckets, -5.0, n_features=1, alternate_sign=False).collect()}
    assert abs(p[1] - 0.993307149) < 1e-6 and abs(p[2] - 0.006692851) < 1e-6


def test_metrics(spark):
    scored = spark.createDataFrame([(1, 0.9), (0, 0.6), (1, 0.4), (0, 0.1)], "label int, p double")
    r = evaluate.evaluate(scored, 0.5).first()
    assert (r.tp, r.tn, r.fp, r.fn, r.accuracy, r.precision, r.recall, r.f1) == (1, 1, 1, 1, 0.5, 0.5, 0.5, 0.5)
    assert [x["threshold"] for x in evaluate.evaluate_sweep(scored, [0.5, 0.5, 0.9]).collect()] == [0.5, 0.9]
    with pytest.raises(ValueError):
        evaluate.evaluate_sweep(scored, [1.5])


def test_readiness(spark, six):
    profiles = spark.createDataFrame([("p", 6, 60)], "profile string, min_samples int, retrain_interval_minutes int")
    models = spark.createDataFrame([], "profile string, trained_at long")
    runs = spark.createDataFrame([], "profile string, status string, timestamp long")
    ready = lambda m, r, need=6: tuple(train.training_readiness(profiles.withColumn("min_samples", F.lit(need)), six, m, r, 100_000).first())[1:]
    assert ready(models, runs) == (True, "model_missing")
    assert ready(models, runs, 7) == (False, "insufficient_samples")
    old = spark.createDataFrame([("p", 100_000 - 90 * 60)], "profile string, trained_at long")
    new = spark.createDataFrame([("p", 100_000 - 60 * 60)], "profile string, trained_at long")
    assert ready(old, runs) == (True, "retrain_interval_elapsed") and ready(new, runs)[0] is False
    failed = spark.createDataFrame([("p", "failed", 99_000)], "profile string, status string, timestamp long")
    assert ready(old, failed) == (False, "cooldown")


def test_repair_from_raw_records(spark, tmp_path):
    """Corrupt lines count in the total alone, a missing hash is computed; a dry run writes nothing, a repair only profiles that differ."""
    import json

    from modq.operators import repair
    from modq.sources.tables import raw_samples, read_samples

    line = lambda i, t, y, **k: json.dumps({"id": i, "text": t, "label": y, "category": None, "created_at": "2026-04-03 10:00:00"} | k)
    a = [line(1, "x", 0), line(2, "x\ny", 1, text_hash="given"), line(3, "x", 1)[:-4], '["no", "object"]', line("four", "x", 0), line(5, "z", 1, created_at="soon"), "", line(None, "w", 0)]
    b = [line(7, "only", 0)]
    rows = [("a", x) for x in a] + [("b", x) for x in b]
    spark.createDataFrame(rows, "profile string, value string").write.partitionBy("profile").text(str(tmp_path / "raw"))
    raw = raw_samples(spark, str(tmp_path / "raw"))
    assert sorted((r["id"], r["created_at"] is None) for r in read_samples(spark, str(tmp_path / "raw"), kind="json").collect()) == [(1, False), (2, False), (5, True), (7, False)]
    assert sorted(r["raw"] for r in raw.where("raw is not null").collect()) == sorted(a[2:5] + a[6:])
    md5 = lambda t: __import__("hashlib").md5(t.encode()).hexdigest()
    want = {("a", "count", 8), ("a", "count:0", 1), ("a", "count:1", 2), ("a", "next_id", 6), ("a", "text_latest:" + md5("x"), 1), ("a", "text_latest:given", 2), ("a", "text_latest:" + md5("z"), 5)}
    right = {("b", "count", 1), ("b", "count:0", 1), ("b", "count:1", 0), ("b", "next_id", 8), ("b", "text_latest:" + md5("only"), 7)}
    meta = repair.meta_table(spark, f"file://{tmp_path}/meta")
    meta.append(spark.createDataFrame([("a", "count", 7), ("a", "text_latest:old", 9), ("gone", "count", 1), *right], repair.META))
    drift, version = repair.repair(meta, raw)
    assert version == meta.current() and {(r["profile"], r["name"], r["stored"]) for r in drift.collect()} == {("a", "text_latest:old", 9), ("gone", "count", 1)} | {(p, n, 7 if n == "count" else None) for p, n, _ in want}
    _, after = repair.repair(meta, raw, dry_run=False)
    assert {tuple(r) for r in meta.read().collect()} == want | right and after.number == 2
    assert [e for e in after.entries if e["profile"] == "b"] == [e for e in version.entries if e["profile"] == "b"]
    assert repair.repair(meta, raw, dry_run=False)[0].count() == 0 and meta.current() == after
