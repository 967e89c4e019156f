"""Hashed features against a plain version, models with their settings, large samples and scratch tables."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from modq.functions.grams import hashed_vectors
from modq.functions.text import murmur3_32
from modq.operators import moderate, store, train
from modq.session import scratch, written

TEXTS = ["Plain words, twice: plain words", "", None, "日本語 text 🙂🙂", "a", " \n\r tab\tspace  ", "x" * 3000, "ab"] + ["".join(random.Random(i).choices("abc dé", k=50)) for i in range(30)]


def features(text, n_features, ngrams, words=False):
    plain = " ".join((text or "").lower().replace("\r", " ").replace("\n", " ").split(" ")) if not words else None
    units = list(__import__("re").sub(r"\s+", " ", plain)) if not words else (text or "").lower().split()
    grams = [("" if not words else " ").join(units[i : i + n]) for n in range(ngrams[0], ngrams[1] + 1) for i in range(len(units) - n + 1)]
    out = Counter()
    for g, h in zip(grams, murmur3_32([g.encode() for g in grams]).tolist() if grams else [], strict=True):
        out[abs(h) % n_features] += -1 if h < 0 else 1
    out = {b: v for b, v in out.items() if v}
    length = math.sqrt(sum(v * v for v in out.values()))
    return {b: v / length for b, v in out.items()}


@pytest.mark.parametrize("analyzer, ngrams", [("char", (2, 4)), ("word", (1, 2))])
def test_hashed_vectors(spark, analyzer, ngrams):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    got = {r["id"]: dict(zip(r["buckets"], r["values"], strict=True)) for r in hashed_vectors(rows, ["id"], n_features=997, ngrams=ngrams, analyzer=analyzer).collect()}
    for i, t in enumerate(TEXTS):
        want = features(t, 997, ngrams, analyzer == "word")
        assert got[i].keys() == want.keys() and all(abs(got[i][b] - v) < 1e-12 for b, v in want.items()), t
    weights = spark.createDataFrame([(b, float(b % 5 - 2)) for b in range(0, 997, 2)], "bucket int, weight double")
    scored = {r["id"]: r["z"] for r in moderate.score_hashed(rows, weights, 0.5, n_features=997, ngrams=ngrams, analyzer=analyzer).collect()}
    for i in got:
        assert abs(scored[i] - 0.5 - sum(v * (b % 5 - 2) for b, v in got[i].items() if b % 2 == 0)) < 1e-9


def test_texts_without_grams_alone(spark):
    rows = spark.createDataFrame([(1, "x"), (2, None)], "id long, text string").coalesce(1)
    assert [list(r["values"]) for r in hashed_vectors(rows, ["id"]).collect()] == [[], []]
    assert {r["z"] for r in moderate.score_hashed(rows, spark.createDataFrame([(0, 1.0)], "bucket int, weight float"), 0.25).collect()} == {0.25}


def test_dense_and_joined_scores_agree(spark, monkeypatch):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    weights = spark.range(997).selectExpr("cast(id as int) bucket", "cast(id % 5 - 2 as float) weight")
    one = {r["id"]: r["z"] for r in moderate.score_hashed(rows, weights, 0.5, n_features=997).collect()}
    monkeypatch.setattr(moderate, "MOST_DENSE", 10)
    two = {r["id"]: r["z"] for r in moderate.score_hashed(rows, weights, 0.5, n_features=997).collect()}
    assert one.keys() == two.keys() and all(abs(one[i] - two[i]) < 1e-9 for i in one)


def test_hashed_model_keeps_its_settings(spark, tmp_path):
    samples = spark.createDataFrame([("p", i, f"{'good' if i % 2 else 'bad'} text {i}", i % 2) for i in range(40)], "profile string, id long, text string, label int")
    version, run = train.train(samples, str(tmp_path), model="hashed", n_features=4096, ngrams=(1, 2), analyzer="word", shards=1)
    assert run.first()["status"] == "completed" and train.current_version(spark, str(tmp_path)) == version
    rows, meta = train.read_model(spark, version)
    back = {r["id"]: r["p"] for r in moderate.score_hashed(samples, rows, meta["intercept"], **meta["features"]).collect()}
    told = {r["id"]: r["p"] for r in moderate.score_hashed(samples, rows, meta["intercept"], n_features=4096, ngrams=(1, 2), analyzer="word").collect()}
    assert back == told and all((p > 0.5) == (i % 2 == 1) for i, p in back.items())
    for bad in ({"ngrams": (3, 2)}, {"ngrams": (0, 2)}, {"n_features": 0}, {"analyzer": "line"}, {"window": 2}):
        with pytest.raises(ValueError):
            train.write_model(rows, {"model_type": "hashed", "intercept": 0.0, "features": bad}, str(tmp_path))
    broken = train.write_model(rows.limit(1).withColumn("weight", F.lit(float("nan")).cast("float")), {"model_type": "hashed", "features": meta["features"]}, str(tmp_path))
    with pytest.raises(ValueError, match="no numbers"):
        train.read_model(spark, broken)


def test_training_without_a_label_fails_with_a_row(spark, tmp_path):
    samples = spark.createDataFrame([("p", i, "text", 0) for i in range(4)], "profile string, id long, text string, label int")
    version, run = train.train(samples, str(tmp_path))
    assert version is None and run.first()["status"] == "failed" and "label" in run.first()["reason"]


def test_large_samples_are_cut_where_they_are(spark, monkeypatch):
    rows = spark.createDataFrame([("p", i, f"t{i}", i % 2) for i in range(500)], "profile string, id long, text string, label int").repartition(5)
    ids = lambda df: sorted(r["id"] for r in df.collect())
    for n in (1, 77, 499, 500, 900):
        small = ids(store.random_samples(rows, n, 7)), ids(store.latest_samples(rows, n))
        monkeypatch.setattr(store, "MOST_SORTED", 0)
        assert (ids(store.random_samples(rows, n, 7)), ids(store.latest_samples(rows, n))) == small
        monkeypatch.undo()
    monkeypatch.setattr(store, "MOST_SORTED", 0)
    doubled = rows.union(rows)
    assert store.random_samples(doubled, 333, 7).count() == 333


def test_scratch_tables_are_deleted(spark, tmp_path):
    with scratch():
        kept = written(spark.range(3), "scratch")
        kept.write.parquet(str(tmp_path / "out"))
    path = kept.written_to.removeprefix("file://").removeprefix("file:")
    assert not __import__("os").path.exists(path) and spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_numpy_spans():
    assert murmur3_32([b"", b"a", b"hello", "é".encode()]).tolist() == murmur3_32([b""]).tolist() + murmur3_32([b"a"]).tolist() + murmur3_32([b"hello"]).tolist() + murmur3_32(["é".encode()]).tolist()
    assert murmur3_32([]).tolist() == [] and murmur3_32([b"hello"]).dtype == np.int32
