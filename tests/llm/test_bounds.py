"""What bounds say: chances of a missed link at every threshold, and rows that reach the driver."""

from math import comb

import pytest

from modq.llm import near_dedup, quality


@pytest.mark.parametrize("threshold", [60, 70, 80, 85, 90, 95])
def test_misses_are_below_one_in_a_million(threshold):
    n, s = near_dedup.SKETCH, threshold / 100
    own = sum(comb(n, i) * (1 - s) ** i * s ** (n - i) for i in range(near_dedup.lookups(threshold), n + 1))
    low = sum(comb(n, i) * s**i * (1 - s) ** (n - i) for i in range(n + 1) if i / n < near_dedup.least_common(threshold) / n)
    assert own < 1e-6 and low < 1e-6
    assert near_dedup.lookups(85) == 17


def test_quality_learns_from_a_bounded_number_of_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i} of {i % 7}") for i in range(30) for _ in range(5)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    seen, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(len(x)) or fit(x, y))
    assert quality.score(docs, labels, train_rows=10).count() == 150
    assert quality.score(docs, labels).count() == 150
    assert seen[0] == 10 and seen[1] <= 30
