"""Chunk logs of server-sent events: frames, events, whole streams and their health."""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modq.functions.text import is_kind, items_of, json_of, string_of
from modq.operators.chat import at, either, has, objects
from modq.session import written

EVENT = "struct<kind:string,key:string,text:string,call_id:string,name:string,finish_reason:string,input_tokens:bigint,output_tokens:bigint>"
#: Fixed value: after more than so many bytes a stream passes whatever it says.
PRECHECK_BYTES = 1048


BLANK = re.compile(r"\r?\n\r?\n")
#: Frames that begin in one chunk are numbered from its number times this.
PER_CHUNK = 1 << 20
#: Parts of a partition's text of a stream: a frame of its own; what stands before the first blank line, after the last one, or has none.
FRAME, HEAD, TAIL, NONE = range(4)
PART = "stream_id string, part int, kind int, frame_seq bigint, dialect string, frame string, marks array<struct<seq:bigint,size:int>>"


def cut_frames(stream_id: str, part: int, chunks: Iterator[tuple[int, str | None, str]]) -> Iterator[tuple]:
    """PART's rows of a stream's neighbouring chunks (seq, dialect, chunk). marks: the chunks of a frame and its blank line, and their characters in it.

    Only the unfinished frame is held.
    """
    held, size, edge, marks, first, seen, said = [], 0, "", [], 0, False, None
    for seq, dialect, chunk in chunks:
        said = dialect if said is None else said
        if not held and not marks:
            first = seq * PER_CHUNK
        if not BLANK.search(edge[-3:] + chunk):
            held.append(chunk)
            marks.append((seq, len(chunk)))
            size, edge = size + len(chunk), (edge + chunk)[-3:]
            continue
        text, start, before = "".join(held) + chunk, 0, size
        n = 0
        for m in BLANK.finditer(text, max(0, size - 3)):
            own = [*marks, (seq, m.end() - max(start, before))] if start == 0 else [(seq, m.end() - start)]
            yield stream_id, part, FRAME if seen else HEAD, first, said, text[start : m.start()], own
            start, seen, marks, n = m.end(), True, [], n + 1
            first = seq * PER_CHUNK + n
        held, size, edge = [text[start:]], len(text) - start, text[start:][-3:]
        marks = [(seq, size)]
    yield stream_id, part, TAIL if seen else NONE, first, said, "".join(held), marks


def chunks_to_frames(chunks: DataFrame) -> DataFrame:
    """stream_id, dialect, frame_seq (ascending), event, data, end_seq for chunks (stream_id, seq, dialect, chunk) cut anywhere.

    Frames end at an empty line; a last partial frame counts too. end_seq: the chunk that holds the end of the frame's empty line; null for a partial frame.

    Chunks are range-sorted by stream and number, so a stream of any length is cut over tasks, and no row holds more than a frame. A task gives the
    frames within its range; what stands before its first and after its last blank line is joined with that of the ranges beside it.
    """
    ranged = chunks.select("stream_id", F.col("seq").cast("bigint").alias("seq"), "dialect", F.coalesce("chunk", F.lit("")).alias("chunk")).repartitionByRange("stream_id", "seq").sortWithinPartitions("stream_id", "seq")
    columns = [c.split()[0] for c in PART.replace(",size", ";size").split(", ")]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[batch.column(c).to_pylist() for c in ("stream_id", "part", "seq", "dialect", "chunk")], strict=True)

    def packed(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("stream_id", pa.string()), ("part", pa.int32()), ("kind", pa.int32()), ("frame_seq", pa.int64()), ("dialect", pa.string()), ("frame", pa.string()), ("marks", pa.list_(pa.struct([("seq", pa.int64()), ("size", pa.int32())])))])
        out, size = [], 0
        for row in rows:
            out.append({**dict(zip(columns, row, strict=True)), "marks": [{"seq": a, "size": b} for a, b in row[-1]]})
            size += len(row[5])
            if size >= 1 << 20 or len(out) >= 10_000:
                yield pa.RecordBatch.from_pylist(out, kind)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, kind)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streams = itertools.groupby(rows_of(batches), key=lambda r: (r[0], r[1]))
        yield from packed(row for (stream, part), rows in streams for row in cut_frames(stream, part, (r[2:] for r in rows)))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined() -> Iterator[tuple]:
            for batch in batches:
                for stream, seq, dialect, text, marks, ended in zip(*[batch.column(c).to_pylist() for c in ("stream_id", "frame_seq", "dialect", "frame", "marks", "ended")], strict=True):
                    at, ends = 0, []  # where each chunk's characters end
                    for m in marks:
                        at += m["size"]
                        ends.append(at)
                    start, found = 0, list(BLANK.finditer(text))
                    for n, m in enumerate([*found, None]):
                        stop, over = (m.start(), m.end()) if m else (len(text), len(text))
                        last = marks[min(bisect.bisect_left(ends, over), len(marks) - 1)]["seq"] if m else marks[-1]["seq"] if ended else None
                        yield stream, 0, FRAME, seq + n, dialect, text[start:stop], [(last, 0)] if last is not None else []
                        start = over

        yield from packed(joined())

    parts = written(ranged.withColumn("part", F.spark_partition_id()).mapInArrow(scan, PART), "frame-parts")
    edges = parts.where(F.col("kind") != FRAME)
    upto = Window.partitionBy("stream_id").orderBy("part", "kind")
    segments = edges.withColumn("segment", F.sum((F.col("kind") == TAIL).cast("int")).over(upto))
    pieces = F.array_sort(F.collect_list(F.struct("part", "kind", "frame", "marks", "dialect", "frame_seq")))
    whole = segments.groupBy("stream_id", "segment").agg(pieces.alias("p")).select(
        "stream_id", F.array_min(F.transform("p", lambda x: x.frame_seq)).alias("frame_seq"), F.try_element_at(F.filter(F.transform("p", lambda x: x.dialect), lambda x: x.isNotNull()), F.lit(1)).alias("dialect"),
        F.array_join(F.transform("p", lambda x: x.frame), "").alias("frame"), F.flatten(F.transform("p", lambda x: x.marks)).alias("marks"), F.exists("p", lambda x: x.kind == HEAD).alias("ended"),
    )
    frames = parts.where(F.col("kind") == FRAME).unionByName(whole.mapInArrow(again, PART))
    end = F.try_element_at("marks", F.lit(-1)).seq
    return parsed_frames(frames.withColumn("end_seq", end))


def body_frames(bodies: DataFrame) -> DataFrame:
    return parsed_frames(bodies.select("stream_id", "dialect", F.posexplode(F.split("body", "\r?\n\r?\n")).alias("frame_seq", "frame")))


def parsed_frames(frames: DataFrame) -> DataFrame:
    """stream_id, dialect, frame_seq, event, data (and end_seq, if they have it) of frames (stream_id, dialect, frame_seq, frame); those without event
    and data are left out."""
    lines = F.transform(F.split("frame", "\r?\n"), lambda x: x)
    data = F.array_join(F.transform(F.filter(lines, lambda x: x.startswith("data:")), lambda x: F.regexp_replace(x, "^data: ?", "")), "\n")
    event = F.try_element_at(F.transform(F.filter(lines, lambda x: x.startswith("event:")), lambda x: F.regexp_replace(x, "^event: ?", "")), F.lit(1))
    out = frames.select("stream_id", "dialect", "frame_seq", event.alias("event"), data.alias("data"), *[c for c in ("end_seq",) if c in frames.columns])
    return out.where("data <> '' or event is not null")


def _event(kind: str, **fields: Column) -> Column:
    kinds = {"key": "string", "text": "string", "call_id": "string", "name": "string", "finish_reason": "string", "input_tokens": "bigint", "output_tokens": "bigint"}
    return F.struct(F.lit(kind).alias("kind"), *[(fields.get(n, F.lit(None)) if fields.get(n) is not None else F.lit(None)).cast(t).alias(n) for n, t in kinds.items()])


def _some(condition: Column, event: Column) -> Column:
    return F.when(either(condition), event)


def frames_to_events(frames: DataFrame) -> DataFrame:
    """stream_id, frame_seq, sub, kind (text, reasoning, tool_start, tool_args, tool_whole, final, done), key, text, call_id, name, finish_reason, tokens.

    Frames whose data are no JSON give nothing, [DONE] gives done. key says which call arguments belong to.
    """
    v, t = F.col("v"), F.coalesce(string_of(F.col("v"), "$.type"), F.col("event"), F.lit(""))
    none = F.array().cast(f"array<{EVENT}>")
    number = lambda path: F.try_variant_get(v, path, "bigint")
    filled = lambda c: c.isNotNull() & (c != "")
    choice = at(v, "$.choices[0]")
    delta_text, delta_reason = string_of(choice, "$.delta.content"), string_of(choice, "$.delta.reasoning_content")
    usage = {"input_tokens": number("$.usage.prompt_tokens"), "output_tokens": number("$.usage.completion_tokens")}
    calls = F.coalesce(objects(items_of(choice, "$.delta.tool_calls")), F.array().cast("array<variant>"))
    index = lambda c: F.coalesce(F.try_variant_get(c, "$.index", "string"), F.lit("0"))
    chat = F.concat(
        F.array(_some(filled(delta_reason), _event("reasoning", text=delta_reason)), _some(filled(delta_text), _event("text", text=delta_text))),
        F.flatten(F.transform(calls, lambda c: F.array(
            _some(filled(string_of(c, "$.function.name")) | filled(string_of(c, "$.id")), _event("tool_start", key=index(c), call_id=string_of(c, "$.id"), name=string_of(c, "$.function.name"))),
            _some(filled(string_of(c, "$.function.arguments")), _event("tool_args", key=index(c), text=string_of(c, "$.function.arguments"))),
        ))),
        F.array(_some(string_of(choice, "$.finish_reason").isNotNull() | is_kind(at(v, "$.usage"), "OBJECT"), _event("final", finish_reason=string_of(choice, "$.finish_reason"), **usage)), _some(has(v, "$.error"), _event("final", finish_reason=F.lit("error")))),
    )
    status = string_of(v, "$.response.status")
    ended = t.isin("response.completed", "response.incomplete", "response.failed")
    item = at(v, "$.item")
    r_usage = {"input_tokens": number("$.response.usage.input_tokens"), "output_tokens": number("$.response.usage.output_tokens")}
    reason = F.when((status == "incomplete") | (t == "response.incomplete"), "length").when((status == "failed") | (t == "response.failed"), "error").otherwise("stop")
    item_key = F.coalesce(string_of(v, "$.item_id"), F.try_variant_get(v, "$.output_index", "string"))
    responses = F.array(
        _some(t == "response.output_text.delta", _event("text", text=string_of(v, "$.delta"))),
        _some(t.isin("response.reasoning_summary_text.delta", "response.reasoning_text.delta", "response.reasoning.delta"), _event("reasoning", text=string_of(v, "$.delta"))),
        _some((t == "response.output_item.added") & (string_of(item, "$.type") == "function_call"), _event("tool_start", key=F.coalesce(string_of(item, "$.id"), F.try_variant_get(v, "$.output_index", "string")), call_id=F.coalesce(string_of(item, "$.call_id"), string_of(item, "$.id")), name=string_of(item, "$.name"))),
        _some(t == "response.function_call_arguments.delta", _event("tool_args", key=item_key, text=string_of(v, "$.delta"))),
        _some(t == "response.function_call_arguments.done", _event("tool_whole", key=item_key, text=string_of(v, "$.arguments"))),
        _some(ended, _event("final", finish_reason=reason, **r_usage)),
        _some(t == "error", _event("final", finish_reason=F.lit("error"))),
    )
    block_key = F.coalesce(F.try_variant_get(v, "$.index", "string"), F.lit("0"))
    started = at(v, "$.content_block")
    c_usage = {"input_tokens": F.coalesce(number("$.message.usage.input_tokens"), number("$.usage.input_tokens")), "output_tokens": number("$.usage.output_tokens")}
    stop = string_of(v, "$.delta.stop_reason")
    c_reason = F.when(stop == "max_tokens", "length").when(stop == "tool_use", "tool_calls").when(stop.isNotNull(), "stop")
    claude = F.array(
        _some((t == "content_block_start") & (string_of(started, "$.type") == "tool_use"), _event("tool_start", key=block_key, call_id=string_of(started, "$.id"), name=string_of(started, "$.name"))),
        _some((t == "content_block_start") & (string_of(started, "$.type") == "text") & filled(string_of(started, "$.text")), _event("text", text=string_of(started, "$.text"))),
        _some(string_of(v, "$.delta.type") == "text_delta", _event("text", text=string_of(v, "$.delta.text"))),
        _some(string_of(v, "$.delta.type") == "thinking_delta", _event("reasoning", text=string_of(v, "$.delta.thinking"))),
        _some(string_of(v, "$.delta.type") == "input_json_delta", _event("tool_args", key=block_key, text=string_of(v, "$.delta.partial_json"))),
        _some(t.isin("message_start", "message_delta"), _event("final", finish_reason=c_reason, **c_usage)),
        _some(t == "message_stop", _event("done")),
        _some(t == "error", _event("final", finish_reason=F.lit("error"))),
    )
    parts = F.coalesce(objects(items_of(v, "$.candidates[0].content.parts")), F.array().cast("array<variant>"))
    thought = lambda p: F.coalesce(F.try_variant_get(p, "$.thought", "boolean"), F.lit(False))
    g_stop = string_of(v, "$.candidates[0].finishReason")
    g_usage = {"input_tokens": number("$.usageMetadata.promptTokenCount"), "output_tokens": number("$.usageMetadata.candidatesTokenCount")}
    gemini = F.concat(
        F.flatten(F.transform(parts, lambda p, i: F.array(
            _some(filled(string_of(p, "$.text")) & thought(p), _event("reasoning", text=string_of(p, "$.text"))),
            _some(filled(string_of(p, "$.text")) & ~thought(p), _event("text", text=string_of(p, "$.text"))),
            _some(is_kind(at(p, "$.functionCall"), "OBJECT"), _event("tool_start", key=F.concat_ws(".", F.col("frame_seq").cast("string"), i.cast("string")), call_id=F.coalesce(string_of(p, "$.functionCall.id"), F.lit("gemini_call")), name=string_of(p, "$.functionCall.name"))),
            _some(is_kind(at(p, "$.functionCall"), "OBJECT"), _event("tool_args", key=F.concat_ws(".", F.col("frame_seq").cast("string"), i.cast("string")), text=F.to_json(at(p, "$.functionCall.args")))),
        ))),
        F.array(_some(g_stop.isNotNull() | is_kind(at(v, "$.usageMetadata"), "OBJECT"), _event("final", finish_reason=F.when(g_stop == "MAX_TOKENS", "length").when(g_stop == "ERROR", "error").when(g_stop.isNotNull(), "stop"), **g_usage))),
    )
    d = F.col("dialect")
    decoded = F.when(d == "openai_chat", chat).when(d == "openai_responses", responses).when(d == "claude_chat", claude).when(d == "gemini_chat", gemini).otherwise(none)
    events = F.when(F.trim("data") == "[DONE]", F.array(_event("done"))).when(is_kind(v, "OBJECT"), decoded).otherwise(none)
    rows = frames.withColumn("v", json_of(F.col("data"))).select("stream_id", "frame_seq", F.posexplode(F.filter(events, lambda e: e.isNotNull())).alias("sub", "e"))
    return rows.select("stream_id", "frame_seq", "sub", "e.*")


def reassemble_streams(events: DataFrame) -> DataFrame:
    """stream_id, text, reasoning, tool_calls (call_id, name, arguments, in order), finish_reason, input_tokens, output_tokens, done.

    Argument pieces find their call by its key, whichever comes first; whole arguments count only if no piece came.
    """
    order = F.struct("frame_seq", "sub")
    piece = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("frame_seq", "sub", "text")))), lambda x: x.text), "")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order))
    main = events.groupBy("stream_id").agg(
        piece("text").alias("text"), piece("reasoning").alias("reasoning"), last("finish_reason").alias("finish_reason"), last("input_tokens").alias("input_tokens"), last("output_tokens").alias("output_tokens"), F.coalesce(F.bool_or(F.col("kind") == "done"), F.lit(False)).alias("done"),
    )
    parts = events.where("kind in ('tool_start', 'tool_args', 'tool_whole')")
    calls = parts.groupBy("stream_id", "key").agg(
        F.min(F.when(F.col("kind") == "tool_start", order)).alias("started"), F.min_by("call_id", F.when((F.col("kind") == "tool_start") & F.col("call_id").isNotNull(), order)).alias("call_id"), F.min_by("name", F.when((F.col("kind") == "tool_start") & F.col("name").isNotNull(), order)).alias("name"),
        piece("tool_args").alias("pieces"), F.max(F.when(F.col("kind") == "tool_whole", F.col("text"))).alias("whole"),
    )
    arguments = F.when(F.col("pieces") != "", F.col("pieces")).otherwise(F.coalesce("whole", F.lit("")))
    listed = calls.where("started is not null").groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("started", F.coalesce("call_id", F.lit("")).alias("call_id"), F.coalesce("name", F.lit("")).alias("name"), arguments.alias("arguments")))).alias("c"))
    tools = listed.select("stream_id", F.transform("c", lambda x: F.struct(x.call_id.alias("call_id"), x["name"].alias("name"), x.arguments.alias("arguments"))).alias("tool_calls"))
    out = main.join(tools, "stream_id", "left")
    empty = F.array().cast("array<struct<call_id:string,name:string,arguments:string>>")
    return out.select("stream_id", "text", "reasoning", F.coalesce("tool_calls", empty).alias("tool_calls"), "finish_reason", "input_tokens", "output_tokens", "done")


def stream_health(chunks: DataFrame) -> DataFrame:
    """stream_id, bytes, passed_at, passes, message: a stream passes at the chunk that completes a frame by which it has said more than two characters or
    begun a tool call, or that exceeds PRECHECK_BYTES, whichever is first; that chunk is passed_at.

    What only a last partial frame says lets the stream pass at its end, without a chunk. Bytes and characters are summed over light rows, of
    frames only those up to the chunk that exceeds PRECHECK_BYTES.
    """
    running = F.sum("n").over(Window.partitionBy("stream_id").orderBy("seq"))
    sizes = chunks.select("stream_id", "seq", F.octet_length("chunk").alias("n")).select("stream_id", "seq", running.alias("upto"))
    sizes = written(sizes.groupBy("stream_id").agg(F.max("upto").alias("bytes"), F.min(F.when(F.col("upto") > PRECHECK_BYTES, F.col("seq"))).alias("forced_at")), "stream-sizes")
    frames = written(chunks_to_frames(chunks), "frames")
    events = frames_to_events(frames)
    said = F.when(F.col("kind").isin("text", "reasoning"), F.length("text")).otherwise(0)
    called = F.col("kind").isin("tool_start", "tool_args", "tool_whole")
    each = events.groupBy("stream_id", "frame_seq").agg(F.sum(said).alias("said"), F.bool_or(called).alias("called")).where("said > 0 or called")
    each = each.join(frames.select("stream_id", "frame_seq", "end_seq"), ["stream_id", "frame_seq"]).join(sizes.select("stream_id", "forced_at"), "stream_id")
    early = each.where("end_seq is not null and (forced_at is null or end_seq <= forced_at)")
    upto = Window.partitionBy("stream_id").orderBy("frame_seq")
    points = early.withColumn("so_far", F.sum("said").over(upto)).groupBy("stream_id").agg(F.min(F.when((F.col("so_far") > 2) | F.col("called"), F.col("end_seq"))).alias("heard_at"))
    totals = events.groupBy("stream_id").agg(F.sum(said).alias("said"), F.bool_or(called).alias("called"))
    rows = sizes.join(points, "stream_id", "left").join(totals, "stream_id", "left")
    passes = (F.coalesce("said", F.lit(0)) > 2) | F.coalesce("called", F.lit(False)) | F.col("forced_at").isNotNull()
    message = F.when(passes, F.lit(None).cast("string")).when(F.coalesce("bytes", F.lit(0)) == 0, "stream ended without any content").when(F.col("said").isNull(), "stream ended without content events").otherwise("stream content is too short")
    return rows.select("stream_id", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.least("heard_at", "forced_at").alias("passed_at"), passes.alias("passes"), message.alias("message"))
