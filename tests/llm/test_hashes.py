"""Words that simple hashes mix up, hot windows, and an index that a second session opens."""

import numpy as np
from pyspark.sql import functions as F

from modq.llm import near_dedup, substring_dedup
from modq.llm.words import Words


def thue_morse(n, flip):
    return "".join("ab"[(i.bit_count() + flip) % 2] for i in range(n))


def test_hashes_of_words():
    rng = np.random.default_rng(0)
    words = ["".join(map(chr, rng.integers(33, 127, rng.integers(1, 90)))) for _ in range(5000)]
    words += [thue_morse(n, flip) for n in (16, 64, 2048) for flip in (0, 1)] + ["a", "a\0", "\0", "\0\0"]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    moved = np.frombuffer(("xyz " + " ".join(words)).encode(), np.uint8)
    for seed in (0, 1):
        hashes = Words(data, np.array([0, data.size])).hashes(seed).tolist()
        assert len(set(zip(words, hashes, strict=True))) == len(set(words)) == len(set(hashes))
        assert Words(moved, np.array([0, moved.size])).hashes(seed).tolist()[1:] == hashes


def test_words_of_equal_polynomials_stay_apart(spark):
    a, b = thue_morse(2048, 0), thue_morse(2048, 1)
    around = [f"w{i}" for i in range(12)]
    docs = spark.createDataFrame([(1, " ".join([*around[:6], a, *around[6:]])), (2, " ".join([*around[:6], b, *around[6:]]))], "doc_id long, text string")
    assert {r["n_removed"] for r in substring_dedup.dedup(docs).collect()} == {0}
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, words=3, threshold=85).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_settled_windows():
    """Whatever rows meet in one task, the least document of each window and the documents above it are the same."""
    rng = np.random.default_rng(5)
    doc, one = rng.integers(0, 40, 3000), rng.integers(0, 9, 3000).astype(np.uint64)
    two, at = one * np.uint64(7), np.arange(3000, dtype=np.int32)
    least = {k: doc[one == k].min() for k in set(one.tolist())}
    want = {(int(d), int(a)) for d, k, a in zip(doc, one.tolist(), at, strict=True) if d > least[k]}
    parts = [substring_dedup.settled(doc[i : i + 500], one[i : i + 500], two[i : i + 500], at[i : i + 500]).to_pylist() for i in range(0, 3000, 500)]
    rows = [r for p in parts for r in p]
    low = {}
    for r in rows:
        if not r["known"]:
            low[r["one"]] = min(low.get(r["one"], 99), r["doc_id"])
    assert {(r["doc_id"], a) for r in rows if r["known"] or r["doc_id"] > low[r["one"]] for a in r["at"]} == want
    assert sum(not r["known"] for r in rows) < 1000


def test_settled_windows_of_one_document():
    """A window that a document repeats is one row of it, and so are all windows that are settled."""
    doc, one = np.repeat(np.array([3, 1, 2]), 1000), np.tile(np.arange(2, dtype=np.uint64), 1500)
    rows = substring_dedup.settled(doc, one, one, np.arange(3000, dtype=np.int32)).to_pylist()
    assert sorted((r["known"], r["doc_id"], len(r["at"])) for r in rows) == [(False, 1, 500), (False, 1, 500), (True, 2, 1000), (True, 3, 1000)]


def test_frequent_fingerprints_are_dealt(spark):
    """Rows stay, each once; lot 0 has few of a frequent one, and other lots none of the rest."""
    rows = [(7, d) for d in range(5000)] + [(h, d) for h in range(100, 120) for d in range(3)]
    prints = spark.createDataFrame(rows * 2, "hash long, doc_id long").repartition(4, "doc_id")
    got = substring_dedup.dealt(prints, 8).collect()
    assert sorted((r["hash"], r["doc_id"]) for r in got) == sorted(rows)
    assert {r["hash"] for r in got if r["lot"] > 0} == {7}
    lots = [sum(r["lot"] == n and r["hash"] == 7 for r in got) for n in range(9)]
    assert lots[0] == 4 * substring_dedup.FEW and max(lots[1:]) < 2 * min(lots[1:])
    index = substring_dedup.FingerprintIndex(spark, buckets=4)
    run = index.append(prints)
    assert {r["hash"] for r in index.shared(run).collect()} == {7, *range(100, 120)}
    asked = spark.createDataFrame([(7,), (101,), (5,)], "hash long")
    assert sorted((r["hash"], r["doc_id"]) for r in index.having(asked).collect()) == sorted((h, d) for h, d in rows if h in (7, 101))
    assert "Exchange hashpartitioning(hash" not in index.shared(run)._jdf.queryExecution().toString()  # history isn't shuffled
    index.drop()


def test_second_session_opens_the_index(spark):
    text = lambda i: " ".join(f"t{i}x{j}" for j in range(30))
    old = spark.createDataFrame([(i, text(i)) for i in range(6)], "doc_id long, text string")
    index = substring_dedup.FingerprintIndex(spark, max_runs=3)
    substring_dedup.dedup(old, index)
    for run in index.runs:
        spark.sql(f"DROP TABLE {run}")  # a new session's catalogue doesn't know them
    again = substring_dedup.FingerprintIndex.open(spark.newSession(), index.folder)
    assert again.runs == index.runs
    again.spark = spark
    new = spark.createDataFrame([(10, text(2)), (11, text(77)), (12, "a b " + text(3) + " c")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup(new, again, history=old).where(F.col("doc_id") >= 10).collect()}
    assert got == {10: 30, 11: 0, 12: 30}
    last = substring_dedup.FingerprintIndex.open(spark, index.folder)
    assert last.runs == again.runs
    last.drop()
