"""Queries over small tables of their own against their SQL, and bounds that larger tables showed."""

import os

import duckdb
import pytest


def rows_of(spark, folder, name):
    """(a query's rows, its SQL's rows), sorted."""
    import __spark_entry__ as entry

    con = duckdb.connect()
    for f in os.listdir(folder):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}/*.parquet'")
    frame = entry.queries()[name](spark, folder)
    columns = ", ".join(f'"{c}"' for c in frame.columns)
    want = con.sql(f"SELECT {columns} FROM ({entry.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, frame.collect()), key=repr), sorted(want, key=repr)


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """40 pairs of equal texts; the newer one of each, whose number 7 divides, has no category."""
    folder = str(tmp_path_factory.mktemp("copies"))
    docs = [(7 * g + k, f"said {'ill' if g % 2 else 'well'} {g} by {g % 5}", "en", f"src{g}", 20) for g in range(1, 41) for k in (-6, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d[0], 1, int("ill" in d[1])) for d in docs], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_newest_sample_without_category(spark, copies):
    got, want = rows_of(spark, copies, "f11_block_message")
    assert got == want
    assert any(m and "blocked by history" in m for _, m, _ in got)


@pytest.fixture
def parts(monkeypatch):
    """The files that a query writes for its stream, by name."""
    from modq.plans import registry

    made, before = {}, registry.fresh_path
    monkeypatch.setattr(registry, "fresh_path", lambda spark, name: made.setdefault(name, before(spark, name)))
    return lambda name: [f for f in os.listdir(made[name].removeprefix("file://")) if f.startswith("part-")]


@pytest.fixture(scope="module")
def many_files(spark, copies, tmp_path_factory):
    """The same rows in six files, each of which is a task's."""
    folder = str(tmp_path_factory.mktemp("files"))
    for name in ("documents", "labels"):
        spark.read.parquet(f"{copies}/{name}.parquet").repartition(6).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_running_counts_of_many_files(spark, many_files, parts):
    """Both halves are written by more than one task each."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        got, want = rows_of(spark, many_files, "i4_running_counts_stream")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want and len(parts("samples")) > 2


def test_reused_verdicts_of_many_files(spark, many_files, parts):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        got, want = rows_of(spark, many_files, "i2_reuse_verdicts_stream")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want and len(parts("decided")) > 2


def test_least_key_counts_first_over_frames():
    """A batch's rows of a key may come in several frames, in any order."""
    import pandas as pd

    from modq.streaming import state

    class Verdicts(dict):
        containsKey, getValue, updateValue = dict.__contains__, dict.__getitem__, dict.__setitem__

    p = state.VerdictReuse("1 hour")
    p.verdicts = Verdicts()
    frame = lambda *rows: pd.DataFrame([(k, "a", h, f"by {k}", "local", None, k / 10) for k, h in rows], columns=["key", "profile", "text_hash", "decision", "source", "reason", "p"])
    run = lambda *frames: {r.key: (r.decision, r.reused) for r in pd.concat(p.handleInputRows(("a", "0"), iter(frames), None)).itertuples()}
    assert run(frame((7, "x"), (5, "x"), (6, "y")), frame((3, "x"), (9, "y"), (4, "x"))) == {7: ("by 3", True), 5: ("by 3", True), 3: ("by 3", False), 4: ("by 3", True), 6: ("by 6", False), 9: ("by 6", True)}
    assert run(frame((1, "x"), (2, "z"))) == {1: ("by 3", True), 2: ("by 2", False)}


def test_char_grams_in_one_pass(spark):
    """Every code point begins a run, line ends and those beyond 16 bits too; and no expression is evaluated for each run."""
    from pyspark.sql import functions as F

    from modq.functions import text as T

    texts = ["abc", "a", "", None, "a\n\r b", "🙂語🙂🙂é", "\u2028\u0085x$", "  ", "aaaa"]
    want = [[t[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1)] if t else [] for t in texts]
    grams = spark.createDataFrame([(t,) for t in texts], "text string").select(T.char_ngrams(F.col("text"), 2, 4).alias("g"))
    assert [r["g"] for r in grams.collect()] == want
    assert "transform" not in grams._jdf.queryExecution().optimizedPlan().toString()


def test_tokens_are_looked_up_in_slices(spark, monkeypatch):
    """A batch of rows is looked up a slice at a time; a longer text is its own slice."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from modq.functions import terms

    monkeypatch.setattr(terms, "SLICE_TOKENS", terms.SLICE_TOKENS * 0 + 3)
    texts = [None, "a b", "", "c", "a a a a b", "x", "b c", "a", None]
    worth = {"a": 1.0, "b": 10.0, "c": 100.0}
    rows = spark.createDataFrame([(i, "p", t) for i, t in enumerate(texts)], "id long, profile string, text string").coalesce(1)
    want = {i: sum(worth.get(x, 0) for x in (t or "").split()) for i, t in enumerate(texts)}
    for group in (None, "profile"):
        known = pa.table({"term": [(f"p{terms.BETWEEN}" if group else "") + k for k in worth], "weight": list(worth.values())})
        got = terms.token_scores(rows, F.filter(F.split("text", " "), lambda x: x != ""), known, group, ["id"])
        assert {r["id"]: r["s"] for r in got.collect()} == want


def test_a_stream_of_one_batch_stores_no_frames(monkeypatch):
    """Frames and pieces of a call that ends its stream aren't stored; long ones of a call are, and come back in their order."""
    import test_streaming as ts

    from modq.streaming import state

    stored = []
    append = ts.List.appendValue
    monkeypatch.setattr(ts.List, "appendValue", lambda self, v: (stored.append(v), append(self, v)))
    text = ts.body([f"piece {i} " * 20 for i in range(30)])
    rows = [(i // 50, text[i : i + 50]) for i in range(0, len(text), 50)]
    frames, complete, _ = ts.parsed([rows])
    assert complete and not stored
    monkeypatch.setattr(state, "MOST_NEW", 300)
    assert ts.parsed([rows])[:2] == (frames, True) and stored
    assert ts.parsed([rows[:40], rows[90:], rows[40:90]])[:2] == (frames, True)


def test_fallback_scores_once(spark):
    """The scores are read twice, but made once."""
    from modq.operators import moderate

    terms = spark.createDataFrame([("a", 1.0, 2.0)], "term string, idf double, weight double")
    texts = spark.createDataFrame([(i, "a " * (i % 3)) for i in range(9)], "id long, text string")
    out = moderate.capacity_fallback(moderate.score_terms(texts, terms, -1.0), 2)
    assert "MapInArrow" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["id"] for r in out.where("route = 'review'").collect()) == [0, 1]


def test_settings_leave_rows_where_they_are(spark):
    """Rows of one profile aren't brought to one task by its settings."""
    from pyspark.sql import functions as F

    from modq.operators import profiles

    rows = spark.range(0, 600, 1, 6).select(F.col("id"), F.when(F.col("id") % 3 > 0, "big").alias("profile"), F.lit("x").alias("text"))
    for given in ("profile string, low double, seed long", "profile string"):
        own = spark.createDataFrame([("big", 0.4, 7)[: given.count(",") + 1], ("other", 0.1, None)[: given.count(",") + 1]], given)
        out = profiles.with_settings(rows, own)
        assert out.select(F.spark_partition_id()).distinct().count() == 6
        low, seed = (0.4, 7) if "low" in given else (0.2, 42)
        assert {(r["profile"], r["low"], r["seed"], r["max_text"]) for r in out.collect()} == {("big", low, seed, 4000), (None, 0.2, 42, 4000)} and out.count() == 600


def test_batches_for_python_are_small(spark):
    """A worker's batch is bounded by bytes; a session's own limit stays."""
    import pyarrow as pa

    import __spark_entry__ as entry

    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    entry.queries()["f6_force_review"](spark, "/root/testdata/sf0.001")
    rows = spark.range(0, 9000, 1, 1).selectExpr("split(repeat('word ', 300), ' ') AS t")
    got = rows.mapInArrow(lambda batches: (pa.record_batch([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long").collect()
    assert len(got) > 1 and max(r["n"] for r in got) < 9 << 20
    spark.conf.set(limit, "16m")
    try:
        entry.queries()["f6_force_review"](spark, "/root/testdata/sf0.001")
        assert spark.conf.get(limit) == "16m"
    finally:
        spark.conf.unset(limit)


def test_sgd_makes_no_copy_of_a_shard(monkeypatch):
    """A shard's buckets are used where they lie, not joined into one array."""
    from types import SimpleNamespace

    import numpy as np
    import pandas as pd

    from modq.operators import train

    rng = np.random.default_rng(5)
    buckets = [np.sort(rng.choice(5000, 500, False)).astype(np.int32) for _ in range(40)]
    frame = pd.DataFrame({"id": range(40), "turn": [f"{i % 7}" for i in range(40)], "y": [float(i % 2) for i in range(40)], "buckets": buckets, "values": [rng.random(500) for _ in range(40)]})
    monkeypatch.setattr(train.np, "concatenate", lambda *a, **k: pytest.fail("a copy"))
    out = train._epoch(SimpleNamespace(value=np.zeros(5000, np.float32)), 0.1, 0.35, 1e-5, None)(frame)
    assert out["bucket"].to_list() == [-1, *sorted({int(x) for b in buckets for x in b})]
    known = np.unique(np.array(buckets))
    w, bias, n = train.sgd(frame.sort_values(["turn", "id"]), known, np.zeros(known.size, np.float32), 0.1, 0.35, 1e-5)
    assert n == 40 and bias == out["weight"][0] and (w == out["weight"].to_numpy()[1:].astype(np.float32)).all()


def test_capacity_by_profile_scores_once(spark, monkeypatch):
    """Scores are read for the profiles' names and for the routes, but made once."""
    import __spark_entry__ as entry
    from modq.plans import registry

    made, before = [], registry.written
    monkeypatch.setattr(registry, "written", lambda df, name: (made.append(name), before(df, name))[1])
    entry.queries()["f7_capacity_by_profile"](spark, "/root/testdata/sf0.001")
    assert made.count("scores") == 1
