"""Stateful processors: verdicts that are reused, and event streams that are parsed as they arrive."""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

BLANK = re.compile(r"\r?\n\r?\n")
#: Types of the last frame of a stream, by dialect.
ENDS = {"claude_chat": ("message_stop",), "openai_responses": ("response.completed", "response.incomplete", "response.failed")}
DONE = "[DONE]"
#: Characters before a new chunk that may belong to a blank line, or to an end mark, that ends in it.
EDGE = 96
#: Characters of an unfinished frame that is looked through for an end; a longer one waits for its blank line or the watermark.
MOST_LAST = 1 << 16
#: Characters of new frames and pieces that a call holds in memory, about.
MOST_NEW = 1 << 20
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """State of several kinds with times to live needs the RocksDB state store: take it unless another was chosen."""
    if "HDFSBackedStateStoreProvider" in (spark.conf.get(STORE, None) or "HDFSBackedStateStoreProvider"):
        spark.conf.set(STORE, ROCKS)


def millis(duration: str) -> int:
    return int(pd.Timedelta(duration).total_seconds() * 1000)


VERDICT = "decision string, source string, reason string, p double"
VERDICTS = f"profile string, text_hash string, {VERDICT}, reused boolean"


class VerdictReuse(StatefulProcessor):
    """Per (profile, shard of hashes): a map from text hash to the verdict that the text had first, each with a time to live of its own.

    Of a batch the row with the least key counts first, in whatever order its rows arrive; their keys are in memory until then."""

    def __init__(self, ttl: str):
        self.ttl = millis(ttl)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.verdicts = handle.getMapState("verdicts", "text_hash string", VERDICT, self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # of this batch: the number of each text, its least row's key, place and verdict, and of all rows only keys and texts' numbers
        texts: dict[str, int] = {}
        least, parts = [], []
        for frame in rows:
            frame = frame.sort_values("key", kind="stable").reset_index(drop=True)
            for row in frame.drop_duplicates("text_hash").itertuples():
                n = texts.setdefault(row.text_hash, len(texts))
                found = (row.key, (len(parts), row.Index), tuple(None if pd.isna(v) else v for v in (row.decision, row.source, row.reason, row.p)))
                if n == len(least):
                    least.append(found)
                elif pd.isna(least[n][0]) or row.key < least[n][0]:
                    least[n] = found
            parts.append((frame["key"].to_numpy(), frame["text_hash"].map(texts).to_numpy()))
        names, verdicts, owners = list(texts), [], []
        for name, (_, place, own) in zip(names, least, strict=True):  # the store is asked once for each text
            held = self.verdicts.containsKey((name,))
            if not held:
                self.verdicts.updateValue((name,), own)
            verdicts.append(tuple(self.verdicts.getValue((name,))) if held else own)
            owners.append(None if held else place)
        for i, (keys, numbers) in enumerate(parts):
            out = [(k, key[0], names[n], *verdicts[n], owners[n] != (i, j)) for j, (k, n) in enumerate(zip(keys, numbers, strict=True))]
            yield pd.DataFrame(out, columns=["key", "profile", "text_hash", "decision", "source", "reason", "p", "reused"]).astype({"p": "float64"})

    def close(self) -> None:
        pass


def has_end(frame: str, dialect: str | None) -> bool:
    """Whether a frame ends a stream."""
    lines = frame.replace("\r\n", "\n").split("\n")
    data = "\n".join(x[5:].removeprefix(" ") for x in lines if x.startswith("data:"))
    if data.strip() == DONE:
        return True
    if not any(e in frame for e in ENDS.get(dialect or "", ())):
        return False
    event = next((x[6:].removeprefix(" ") for x in lines if x.startswith("event:")), None)
    try:
        value = json.loads(data)
    except ValueError:
        return False
    return isinstance(value, dict) and value.get("type", event) in ENDS[dialect]


FRAMES = "stream_id string, dialect string, frame_seq bigint, frame string, complete boolean"
#: Where a stream's parser stands: next chunk, characters of the unfinished frame, its last ones, finished frames, newest time, whether the stream has ended.
POSITION = "next bigint, size bigint, edge string, frames bigint, dialect string, ms bigint, ended boolean"


class FrameAssembly(StatefulProcessor):
    """Per stream: a resumable parser. Chunks in their turn are parsed and never kept whole; early ones wait under their number."""

    def __init__(self, idle: str, first: int = 0):
        self.idle, self.first = millis(idle), first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.position = handle.getValueState("position", POSITION)
        self.frames = handle.getListState("frames", "frame string")
        self.pieces = handle.getListState("pieces", "piece string")
        self.early = handle.getMapState("early", "seq bigint", "chunk string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.position.exists()
        at = self.position.get() if known else (self.first, 0, "", 0, None, 0, False)
        at = dict(zip(("next", "size", "edge", "frames", "dialect", "ms", "ended"), at, strict=True))
        newest, before = at["ms"], at["ended"]
        self._open()
        for frame in rows:
            frame = frame.sort_values("seq", kind="stable")
            newest = max(newest, int(frame["ms"].max()))
            if before:
                continue
            for seq, dialect, chunk in zip(frame["seq"], frame["dialect"], frame["chunk"], strict=True):
                at["dialect"] = at["dialect"] if pd.isna(dialect) else dialect
                seq, chunk = int(seq), "" if pd.isna(chunk) else chunk
                if seq == at["next"]:
                    self._feed(at, chunk)
                    self._drain(at)
                elif seq > at["next"]:
                    self.early.updateValue((seq,), (chunk,))
                    self.waits = True
                self._spill(MOST_NEW)
        self._arm(at, max(newest, at["ms"]), timerValues, known)
        if at["ended"] and not before:
            yield from self._given(key, at, True)
            self._clear(at)
        else:
            self._spill(0)
        # an ended stream is remembered until it has been idle, so that what comes after its end begins no new one
        self.position.update(tuple(at.values()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = dict(zip(("next", "size", "edge", "frames", "dialect", "ms", "ended"), self.position.get(), strict=True))
        self._open()
        if not at["ended"]:
            # gaps are passed over
            for seq, chunk in sorted((k[0], v[0]) for k, v in self.early.iterator()):
                at["next"] = seq
                self._feed(at, chunk)
                self._spill(MOST_NEW)
            yield from self._given(key, at, False)
            self._clear(at)
        self.position.clear()

    def _arm(self, at: dict, newest: int, timerValues, known: bool) -> None:
        for t in list(self.handle.listTimers()) if known else ():
            self.handle.deleteTimer(t)
        at["ms"] = newest
        self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs() + 1, newest + self.idle))

    def _open(self) -> None:
        """New frames and pieces of a call are in memory; what is stored comes before them. A call that ends its stream needn't store them."""
        self.new_frames, self.new_pieces, self.new_size, self.waits = [], [], 0, None

    def _spill(self, most: int) -> None:
        """Store the new frames and pieces, once they have more than `most` characters."""
        if self.new_size > most:
            for frame in self.new_frames:
                self.frames.appendValue((frame,))
            for piece in self.new_pieces:
                self.pieces.appendValue((piece,))
            self.new_frames, self.new_pieces, self.new_size = [], [], 0

    def _unfinished(self, at: dict) -> str:
        """The unfinished frame so far; the store is asked only for what this call hasn't seen."""
        new = "".join(self.new_pieces)
        return new if len(new) == at["size"] else "".join(p[0] for p in self.pieces.get()) + new

    def _drain(self, at: dict) -> None:
        if self.waits is None:  # asked once a call
            self.waits = self.early.exists()
        while self.waits and self.early.containsKey((at["next"],)):
            chunk = self.early.getValue((at["next"],))[0]
            self.early.removeKey((at["next"],))
            self._feed(at, chunk)

    def _feed(self, at: dict, chunk: str) -> None:
        """Parse the next chunk. Pieces of the unfinished frame are joined only when its blank line has come."""
        at["next"] += 1
        window = at["edge"][-3:] + chunk
        found = BLANK.search(window)
        if found:
            whole = self._unfinished(at) + chunk if at["size"] else chunk
            start = max(0, at["size"] - 3)
            parts = BLANK.split(whole[start:])
            parts[0] = whole[:start] + parts[0]
            *done, rest = parts
            if at["size"] > sum(map(len, self.new_pieces)):
                self.pieces.clear()
            self.new_pieces = []
            at["size"], at["edge"] = 0, ""
            for frame in done:
                self.new_frames.append(frame)
                self.new_size += len(frame) + 1
                at["frames"] += 1
                # what has arrived with the end and stands behind it is a part of the body
                at["ended"] = at["ended"] or has_end(frame, at["dialect"])
            chunk = rest
        if chunk:
            self.new_pieces.append(chunk)
            self.new_size += len(chunk)
            at["size"] += len(chunk)
            at["edge"] = (at["edge"] + chunk)[-EDGE:]
        # a last frame needs no blank line
        if at["size"] <= MOST_LAST and (DONE in at["edge"] or at["edge"].rstrip().endswith("}") and at["dialect"] in ENDS):
            last = self._unfinished(at)
            at["ended"] = at["ended"] or has_end(last, at["dialect"])

    def _given(self, key, at: dict, complete: bool) -> Iterator[pd.DataFrame]:
        """The frames so far, in frames of some rows, and what stands of the last one."""
        out, size, n = [], 0, 0
        stored = (f[0] for f in self.frames.get()) if at["frames"] > len(self.new_frames) else ()
        for frame in itertools.chain(stored, self.new_frames):
            out.append((key[0], at["dialect"], n, frame, complete))
            n, size = n + 1, size + len(frame)
            if size >= 1 << 20:
                yield pd.DataFrame(out, columns=FRAME_NAMES)
                out, size = [], 0
        out.append((key[0], at["dialect"], n, self._unfinished(at), complete))
        yield pd.DataFrame(out, columns=FRAME_NAMES)

    def _clear(self, at: dict) -> None:
        """Remove what is stored of a stream that was given out."""
        if at["frames"] > len(self.new_frames):
            self.frames.clear()
        if at["size"] > sum(map(len, self.new_pieces)):
            self.pieces.clear()
        if self.waits is not False:
            self.early.clear()

    def close(self) -> None:
        pass


FRAME_NAMES = [c.split()[0] for c in FRAMES.split(", ")]
