"""Training over a whole table: no small bound on samples or terms, shards that grow with the samples."""

from modq.operators import train
from modq.plans import registry


def test_g1_learns_from_more_than_a_few_samples_and_terms(spark, tmp_path):
    n = 600
    spark.createDataFrame([(i, f"all t{i % 450}", "en", "s", 8) for i in range(n)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, i % 2) for i in range(n)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r["term"]: r for r in registry.QUERIES["g1_train_terms"](spark, str(tmp_path)).collect()}
    assert set(got) == {"all", *(f"t{i}" for i in range(450))}
    assert (got["all"]["df"], got["all"]["pass_hits"], got["all"]["violation_hits"]) == (n, n // 2, n // 2)


def test_shards_follow_the_sample_count(spark, monkeypatch):
    samples = spark.createDataFrame([(i, f"text {i * 7} of {i % 2}", i % 2) for i in range(30)], "id long, text string, label int")
    model = lambda **k: {r["bucket"]: r["weight"] for r in train.train_hashed(samples, epochs=1, **k)[0].collect()}
    monkeypatch.setattr(train, "SHARD", 10)
    assert model() == model(shards=3) != model(shards=8)
