"""Stateful streaming: frames for every cut and order, zones, verdicts reused and forgotten, the learning loop, upserts."""

import datetime
import json
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from modq.operators import sample_table, streams
from modq.streaming import jobs, state

START = datetime.datetime(2026, 4, 3, 10)


class Held:
    """State of one key in memory, and how many characters were read from it."""

    def __init__(self):
        self.values, self.read = {}, 0

    def getValueState(self, name, schema, ttl=None):
        return Value(self, name)

    def getListState(self, name, schema, ttl=None):
        return List(self, name)

    def getMapState(self, name, key, value, ttl=None):
        return Map(self, name)

    def registerTimer(self, at):
        self.values.setdefault("timers", set()).add(at)

    def deleteTimer(self, at):
        self.values["timers"].discard(at)

    def listTimers(self):
        return iter(list(self.values.get("timers", ())))


class Value:
    def __init__(self, held, name):
        self.held, self.name = held, name

    def exists(self):
        return self.name in self.held.values

    def get(self):
        return self.held.values[self.name]

    def update(self, v):
        self.held.values[self.name] = v

    def clear(self):
        self.held.values.pop(self.name, None)


class List(Value):
    def get(self):
        for v in self.held.values.get(self.name, []):
            self.held.read += len(v[0])
            yield v

    def appendValue(self, v):
        self.held.values.setdefault(self.name, []).append(v)


class Map(Value):
    def containsKey(self, k):
        return k in self.held.values.get(self.name, {})

    def getValue(self, k):
        self.held.read += len(self.held.values[self.name][k][0])
        return self.held.values[self.name][k]

    def updateValue(self, k, v):
        self.held.values.setdefault(self.name, {})[k] = v

    def removeKey(self, k):
        self.held.values[self.name].pop(k)

    def iterator(self):
        return iter(list(self.held.values.get(self.name, {}).items()))


class Clock:
    def getCurrentWatermarkInMs(self):
        return 0


def parsed(batches, dialect="openai_chat", number=0):
    """(frames, complete) that the processor gives for arrivals [[(seq, chunk), ...], ...], at the end mark or the timer, and characters read from state."""
    held, p, out = Held(), state.FrameAssembly("10 minutes", number), []
    p.init(held)
    for rows in batches:
        frame = pd.DataFrame([(s, dialect, c, 1000) for s, c in rows], columns=["seq", "dialect", "chunk", "ms"])
        out += list(p.handleInputRows(("s",), iter([frame]), Clock()))
    read = held.read
    if not out:
        out += list(p.handleExpiredTimer(("s",), Clock(), None))
    got = pd.concat(out)
    return list(got["frame"]), bool(got["complete"].all()), read


def body(pieces, line="\n", done=True):
    frames = ["data: " + json.dumps({"choices": [{"delta": {"content": p}}]}, ensure_ascii=False) for p in pieces] + ["data: [DONE]"] * done
    return "".join(f + line * 2 for f in frames)


BODIES = [body(["hi", "", "zwei [DONE] \n\n drei", "日本 🙂"]), body(["a", "b"], "\r\n"), "data: {}\n\r\n\r\n\ndata: [DONE]", "event: x\ndata: 1\n\n\n\r\n\r\ndata: [DONE]\r\n\r\n"]


@pytest.mark.parametrize("text", BODIES)
def test_every_cut_gives_the_frames_of_the_whole(text):
    kept = lambda frames: [f.strip("\r\n") for f in frames if f.strip()]  # noqa: E731  an end mark may come before its line's end
    want = kept(state.BLANK.split(text))
    rng = random.Random(2)
    cuts = [[i] for i in range(len(text) + 1)] + [sorted(rng.sample(range(len(text)), min(len(text), rng.randint(2, 30)))) for _ in range(60)] + [list(range(1, len(text)))]
    for cut in cuts:
        chunks = [text[a:b] for a, b in zip([0, *cut], [*cut, len(text)], strict=True)]
        for first in (0, 1):
            rows = list(enumerate(chunks, first))
            assert kept(parsed([[r] for r in rows], number=first)[0]) == want
            rng.shuffle(rows)
            half = len(rows) // 2
            frames, complete, _ = parsed([rows[:half], rows[half:]] if half else [rows], number=first)
            assert kept(frames) == want and complete


def test_an_end_within_data_or_before_its_chunks_ends_nothing():
    text = BODIES[0]
    assert parsed([[(0, text[:40])], [(3, "data: [DONE]\n\n")]])[1] is False
    frames, complete, _ = parsed([[(0, 'event: message_stop\ndata: {"type": "other", "x": "message_stop"}\n\n')], [(1, 'data: {"type":"message_stop"}')]], "claude_chat")
    assert complete and len(frames) == 2
    # after the end nothing begins anew
    held, p = Held(), state.FrameAssembly("10 minutes")
    p.init(held)
    send = lambda s, c: list(p.handleInputRows(("s",), iter([pd.DataFrame([(s, "openai_chat", c, 1)], columns=["seq", "dialect", "chunk", "ms"])]), Clock()))
    assert send(0, "data: [DONE]\n\n") and not send(1, "data: late\n\n")
    assert not list(p.handleExpiredTimer(("s",), Clock(), None)) and not held.values.get("position")


def test_an_arrival_reads_no_more_than_its_frame():
    """The characters read from state until the end grow with the stream, not with its square."""
    reads = []
    for n in (200, 400):
        text = body(["word " * 8] * n)
        chunks = [text[i : i + 10] for i in range(0, len(text), 10)]
        frames, complete, read = parsed([[r] for r in enumerate(chunks)])
        assert complete and sum(bool(f.strip()) for f in frames) == n + 1
        reads.append(read)
    assert reads[1] < 2.2 * reads[0]


def files(spark, tmp_path, name, batches):
    """A stream that gives each of these tables as one batch."""
    for i, df in enumerate(batches):
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        if i + 1 < len(batches):
            time.sleep(1.1)  # files are taken by their time, in seconds
    return spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")


def finish(writer, timers=True):
    from pyspark.sql import SparkSession

    return jobs.run_available(SparkSession.getActiveSession(), writer, timers)


@pytest.mark.parametrize("zone", ["America/Los_Angeles", "Asia/Tokyo"])
def test_streams_in_any_zone(spark, tmp_path, zone):
    """Chunks seconds apart are one stream, and an idle one is given out, whatever the session's zone."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        rng, rows = random.Random(1), []
        bodies = {f"s{i}": body([f"part {i} ", "日本", "end"], rng.choice(["\n", "\r\n"]), i % 3 > 0) for i in range(9)}
        for s, text in bodies.items():
            cuts = sorted(rng.sample(range(1, len(text)), 7))
            rows += [(s, n, "openai_chat", text[a:b], rng.randint(0, 1)) for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(text)], strict=True))]
        schema = "stream_id string, seq long, dialect string, chunk string"
        base = F.timestamp_seconds(F.lit(1_775_210_400))
        table = lambda picked, later: spark.createDataFrame([r[:4] for r in picked], schema).withColumn("ts", base + F.make_interval(secs=F.lit(later)))
        last = table([("late", 0, "openai_chat", "data: [DONE]\n\n", 0)], 3600)
        batches = [table([r for r in rows if r[4] == b], 7 * b) for b in range(2)] + [last]
        sink = str(tmp_path / "sink")
        finish(jobs.reassemble_streams_stream(files(spark, tmp_path, "chunks", batches), sink, str(tmp_path / "state")))
        got = {r["stream_id"]: (r["text"], r["done"]) for r in spark.read.parquet(sink).collect()}
        whole = spark.createDataFrame([r[:4] for r in rows], schema)
        want = {r["stream_id"]: (r["text"], r["done"]) for r in streams.reassemble_streams(streams.frames_to_events(streams.chunks_to_frames(whole))).collect()}
        assert {s: v for s, v in got.items() if s in bodies} == want and len(want) == 9
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


DECIDED = "id long, profile string, text_hash string, decision string, source string, reason string, p double"


def test_verdicts_are_reused_and_forgotten(spark, tmp_path):
    """Rows in are rows out; every repeat has the first's verdict, in its batch and in later ones, until it is forgotten."""
    first = [(1, "a", "00x", "allow", "local", "one", 0.1), (2, "a", "00x", "block", "local", "two", 0.9), (3, "b", "00x", "review", "review", None, None), (4, "a", "00y", "block", "keyword", "k", None)]
    second = [(5, "a", "00x", "review", "review", None, 0.5), (6, "b", "00x", "allow", "local", "six", 0.0), (7, None, "00x", "allow", "local", "seven", 0.0), (8, "a", "zzz", "allow", "local", None, 0.0)]
    batches = [spark.createDataFrame(rows, DECIDED) for rows in (first, second)]
    sink = str(tmp_path / "sink")
    stream = files(spark, tmp_path, "decided", batches)
    run = lambda s, ttl, name: finish(jobs.reuse_verdicts_stream(s, ttl=ttl).writeStream.format("parquet").option("path", f"{sink}-{name}").option("checkpointLocation", str(tmp_path / f"state-{name}")), False)
    run(stream, "1 hour", "kept")
    got = {r["id"]: (r["decision"], r["reason"], r["p"], r["reused"]) for r in spark.read.parquet(f"{sink}-kept").collect()}
    assert got == {
        1: ("allow", "one", 0.1, False), 2: ("allow", "one", 0.1, True), 3: ("review", None, None, False), 4: ("block", "k", None, False),
        5: ("allow", "one", 0.1, True), 6: ("review", None, None, True), 7: ("allow", "seven", 0.0, False), 8: ("allow", None, 0.0, False),
    }
    run(stream, "1 millisecond", "forgotten")  # batches are further apart
    got = {r["id"]: (r["reason"], r["reused"]) for r in spark.read.parquet(f"{sink}-forgotten").collect()}
    assert len(got) == 8 and got[5] == (None, False) and got[6] == ("six", False)


def test_local_decisions_on_a_stream(spark, tmp_path):
    """On a stream as on a table; and as moderate() without history decides."""
    from modq.operators import moderate

    rows = [(i, "a" if i % 2 else None, t) for i, t in enumerate(["good words", "bad words", "a needle", None, "good good", "x" * 50, "bad"] * 2)]
    texts = spark.createDataFrame(rows, "id long, profile string, text string")
    words = spark.createDataFrame([(1, "Needle", "needle")], "pos int, original string, normalized string")
    terms = spark.createDataFrame([("good", 1.0, -3.0), ("bad", 1.0, 3.0)], "term string, idf double, weight double")
    local = lambda t: jobs.local_decisions(t, words, terms, 0.5, max_text=20, review_rate=0.3)
    sink = str(tmp_path / "sink")
    finish(local(files(spark, tmp_path, "texts", [texts])).writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "state")))
    kept = lambda df: sorted((tuple(r) for r in df.select("id", "text_hash", "decision", "source", "reason", "p").collect()), key=str)
    history = spark.createDataFrame([], "profile string, id long, text string, label int, category string, text_hash string")
    whole = moderate.moderate(texts, words, lambda t: moderate.score_terms(t, terms, 0.5), history, max_text=20, review_rate=0.3)
    assert kept(spark.read.parquet(sink)) == kept(local(texts)) == kept(whole)


def test_learning_loop(spark, tmp_path):
    """What a reviewer says about a text of the first batch is a history hit in the second; a replayed batch adds no sample."""
    table = sample_table.sample_table(spark, f"file://{tmp_path}/samples")
    words = spark.createDataFrame([], "pos int, original string, normalized string")
    unsure = lambda t: t.select("id", F.lit(0.5).alias("p"))
    texts = lambda rows: spark.createDataFrame(rows, "id long, profile string, text string")
    sink, queue, loop = (str(tmp_path / n) for n in ("decisions", "queue", "loop"))

    def moderated():
        stream = spark.readStream.schema("id long, profile string, text string").parquet(str(tmp_path / "requests"))
        finish(jobs.moderate_stream(stream, words, unsure, table.read, sink, str(tmp_path / "state"), queue))
        return {r["id"]: (r["decision"], r["source"]) for r in spark.read.parquet(sink).collect()}

    texts([(1, "a", "rude"), (2, "a", "kind"), (3, "b", "rude"), (4, "a", "unclear"), (5, "a", "rude")]).write.parquet(str(tmp_path / "requests"))
    assert set(moderated().values()) == {("review", "review")}
    waiting = spark.read.parquet(queue)
    assert waiting.count() == 4
    said = F.when(F.col("text") == "rude", F.lit('{"violation": true, "category": "insult"}')).when(F.col("text") == "kind", F.lit('ok {"violation": false}')).otherwise(F.lit("no idea"))
    judged = waiting.where("profile = 'a'").select("profile", "text_hash", said.alias("content"), (F.col("queued_at") + F.expr("interval 5 minutes")).alias("judged_at"))
    late = waiting.where("profile = 'b'").select("profile", "text_hash", F.lit('{"violation": true}').alias("content"), (F.col("queued_at") + F.expr("interval 3 hours")).alias("judged_at"))
    judged.unionByName(judged.where("content not like 'no%'")).unionByName(late).write.parquet(str(tmp_path / "verdicts"))

    def learned(checkpoint):
        asked = spark.readStream.schema(waiting.schema).parquet(queue)
        told = spark.readStream.schema(judged.schema).parquet(str(tmp_path / "verdicts"))
        finish(jobs.learn_stream(asked, told, table, str(tmp_path / "rejects"), checkpoint))
        return sorted((r["profile"], r["id"] in (1, 2), r["text"], r["label"], r["category"]) for r in table.read().collect())

    samples = learned(loop)
    assert [(p, t, y, c) for p, _, t, y, c in samples] == [("a", "kind", 0, None), ("a", "rude", 1, "insult")]
    assert spark.read.parquet(str(tmp_path / "rejects")).select("content").distinct().collect()[0][0] == "no idea"
    # the same batches from a lost checkpoint: the ledger knows them
    assert learned(loop + "-again") == samples
    texts([(6, "a", "rude"), (7, "a", "kind"), (8, "b", "rude"), (9, "a", "unclear")]).write.mode("append").parquet(str(tmp_path / "requests"))
    got = moderated()
    assert (got[6], got[7], got[8], got[9]) == (("block", "history"), ("allow", "history"), ("review", "review"), ("review", "review"))


def test_counts_are_upserted(spark, tmp_path):
    counts = sample_table.counts_table(spark, f"file://{tmp_path}/counts")
    rows = lambda *r: spark.createDataFrame(list(r), "profile string, label int")
    batches = [rows(("a", 0), ("a", 0), ("b", 1)), rows(("a", 1), ("a", 0)), rows(("c", 0))]
    stream = files(spark, tmp_path, "samples", batches)
    finish(jobs.upsert_counts_stream(stream, counts, str(tmp_path / "state")))
    assert sorted(map(tuple, counts.read().collect())) == [("a", 0, 3), ("a", 1, 1), ("b", 1, 1), ("c", 0, 1)]
    versions = [counts.version(n) for n in counts.numbers()]
    parts = lambda v, p: {e["segment"] for e in v.entries if e["profile"] == p}
    written = [v for v in versions if v.entries]
    assert len(written) >= 3 and parts(written[0], "b") == parts(written[-1], "b")
    before = counts.current()
    sample_table.upsert_counts(counts, spark.createDataFrame([("a", 0, 99)], sample_table.COUNTS), "counts", 0)  # a replay
    assert counts.current() == before
