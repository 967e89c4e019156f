"""Frames of streams that are cut over tasks: every cut, long streams, and the chunk at which a stream passes."""

import bisect
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from modq.operators import streams

SCHEMA = "stream_id string, seq long, dialect string, chunk string"


def cut(rng, text, n):
    at = sorted(rng.choices(range(len(text) + 1), k=n))
    return [text[a:b] for a, b in zip([0, *at], [*at, len(text)], strict=True)]


def chat(piece):
    return "data: " + json.dumps({"choices": [{"delta": {"content": piece}}]}, ensure_ascii=False)


@pytest.mark.parametrize("partitions", [1, 7])
def test_frames_of_any_cut(spark, monkeypatch, partitions):
    """Equal to the frames of whole bodies, blank lines cut in the middle and between tasks, empty chunks and odd line ends too."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng, rows, bodies = random.Random(4), [], []
        for s in range(40):
            line = rng.choice(["\n", "\r\n"])
            frames = [rng.choice([chat(f"part {i} 日本"), f"event: e{i}{line}data: {i}", ": note", f"data: a{line}data: b"]) for i in range(rng.randint(0, 12))]
            text = "".join(f + line * rng.choice([2, 2, 2, 3, 4]) for f in frames) + rng.choice(["", "data: [DONE]", "data: last" + line])
            chunks = list(text) if s % 5 == 0 else cut(rng, text, rng.randint(0, 30))
            rows += [(f"s{s}", n + s % 2, "openai_chat", c) for n, c in enumerate(chunks)]
            bodies.append((f"s{s}", "openai_chat", text))
        # one stream that is longer than all others
        long = "".join(chat(f"word {i}") + "\r\n\r\n" for i in range(500))
        rows += [("long", n, "openai_chat", long[i : i + 11]) for n, i in enumerate(range(0, len(long), 11))]
        bodies.append(("long", "openai_chat", long))
        rng.shuffle(rows)
        listed = lambda df: {k: [(r["event"], r["data"]) for r in v] for k, v in itertools.groupby(sorted(df.collect(), key=lambda r: (r["stream_id"], r["frame_seq"])), key=lambda r: r["stream_id"])}
        got = streams.chunks_to_frames(spark.createDataFrame(rows, SCHEMA).repartition(3))
        assert listed(got) == listed(streams.body_frames(spark.createDataFrame(bodies, "stream_id string, dialect string, body string")))
        assert len({(r["stream_id"], r["frame_seq"]) for r in got.collect()}) == got.count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert streams.chunks_to_frames(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_health(chunks):
    """(bytes, passed_at, passes) of a stream by feeding its chunks one after the other."""
    body, size, at = "", 0, None
    for seq, chunk in chunks:
        body, size = body + chunk, size + len(chunk.encode())
        *frames, _ = body.replace("\r\n", "\n").split("\n\n") if not body.endswith("\r") else body[:-1].replace("\r\n", "\n").split("\n\n")
        said, called = heard(frames)
        if at is None and (said > 2 or called or size > streams.PRECHECK_BYTES):
            at = seq
    said, called = heard(body.replace("\r\n", "\n").split("\n\n"))
    return size, at, said > 2 or called or size > streams.PRECHECK_BYTES


def heard(frames):
    said, called = 0, False
    for f in frames:
        try:
            delta = json.loads(f.removeprefix("data: "))["choices"][0]["delta"]
        except (ValueError, KeyError, TypeError):
            continue
        said += len(delta.get("content") or "") + len(delta.get("reasoning_content") or "")
        called = called or "tool_calls" in delta
    return said, called


def test_the_chunk_at_which_a_stream_passes(spark):
    rng, rows, want = random.Random(8), [], {}
    tool = "data: " + json.dumps({"choices": [{"delta": {"tool_calls": [{"index": 0, "id": "c", "function": {"name": "f", "arguments": "{}"}}]}}]})
    thought = "data: " + json.dumps({"choices": [{"delta": {"reasoning_content": "h"}}]})
    for s in range(120):
        line = rng.choice(["\n", "\r\n"])
        frames = rng.choices([chat(""), chat("a"), chat("🙂"), chat("abc"), thought, tool, "data: no json", ": " + "x" * 300], weights=[5, 4, 2, 1, 2, 1, 2, 1], k=rng.randint(0, 9))
        text = (line * 2).join([*frames, rng.choice(["", "data: [DONE]", chat("end")])])
        chunks = list(enumerate(list(text) if s % 10 == 0 else cut(rng, text, rng.randint(0, 25)), 3))
        rows += [(f"s{s}", n, "openai_chat", c) for n, c in chunks]
        want[f"s{s}"] = plain_health(chunks)
    found = streams.stream_health(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert {r["stream_id"]: (r["bytes"], r["passed_at"], r["passes"]) for r in found} == want
    assert all((r["message"] is None) == r["passes"] for r in found)


def test_no_row_holds_a_body(spark):
    """Marks of a frame are its own chunks, and a task's rows no more than a frame."""
    text = "".join(chat(f"word {i}") + "\n\n" for i in range(300))
    parts = list(streams.cut_frames("s", 0, [(n, None, text[i : i + 10]) for n, i in enumerate(range(0, len(text), 10))]))
    assert max(len(p[5]) for p in parts) < 80 and sum(len(p[5]) for p in parts) + 2 * 300 == len(text)
    ends = [text.index(f'word {i}"') for i in range(300)]
    assert all(bisect.bisect_left([m[0] for m in p[6]], e // 10) < len(p[6]) for p, e in zip(parts, ends, strict=False))
