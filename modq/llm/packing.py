"""Packing along a space-filling curve."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modq.llm import tokens
from modq.llm.words import mix
from modq.session import prepare, written

VOCABULARY = "byte_bpe_50k.json"
SEQUENCE = 1024
HASHED_DIMS, CURVE_DIMS, BITS = 64, 3, 16


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions along the Hilbert curve of integer points (rows x dims, each below 2**bits).

    Gray-code method of Skilling (AIP Conf. Proc. 707, 2004), all points at a time.
    """
    x = points.astype(np.int64).T.copy()
    dims = x.shape[0]
    q = 1 << bits - 1
    while q > 1:
        p = q - 1
        for i in range(dims):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << bits - 1
    while q > 1:
        t = np.where((x[dims - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | x[i] >> b & 1
    return key


def curve_keys(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One key per document: its ids hashed into a signed count vector of unit length, projected
    to CURVE_DIMS by a fixed Gaussian matrix, each coordinate put on a grid by rank under
    the normal law of such projections."""
    n = len(sizes)
    h = mix(ids.astype(np.uint64) + np.uint64(1))
    cell = np.repeat(np.arange(n), sizes) * HASHED_DIMS + (h % np.uint64(HASHED_DIMS)).astype(np.int64)
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    vectors = np.bincount(cell, sign, n * HASHED_DIMS).reshape(n, HASHED_DIMS)
    vectors /= np.maximum(np.sqrt((vectors**2).sum(1, keepdims=True)), 1e-12)
    projected = vectors @ np.random.default_rng(20).standard_normal((HASHED_DIMS, CURVE_DIMS))
    level = 1 / (1 + np.exp(-1.702 * projected))  # close to the normal distribution function
    return hilbert_keys(np.minimum((level * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, row, curve_key, n_tokens, ids (little-endian unsigned 16 or 32 bit) of each whole text and end_id."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer)
        kind = "<u2" if encoder.size <= 1 << 16 else "<u4"
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                ids = [np.append(x, end_id) for x in encoder.ids([t or "" for t in part.column(2).to_pylist()])]
                sizes = np.array([x.size for x in ids])
                keys = curve_keys(np.concatenate(ids), sizes)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array([x.astype(kind).tobytes() for x in ids], pa.binary())], names=["doc_id", "row", "curve_key", "n_tokens", "ids"])

    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInArrow(encode, "doc_id long, row long, curve_key long, n_tokens long, ids binary")


def curve_offsets(encoded: DataFrame) -> DataFrame:
    """row, place: how many ids stand before each document along the curve.

    Light rows only: they are range-sorted by (curve_key, doc_id, row), which also splits a
    key that many documents share; each range's total is added up (one number per
    range reaches the driver), then running sums within ranges.
    """
    order = ["curve_key", "doc_id", "row"]
    parts = max(2, int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    light = encoded.select(*order, "n_tokens").repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    light = written(light, "curve")
    before, starts = 0, []
    for part, total in sorted(tuple(r) for r in light.groupBy("part").agg(F.sum("n_tokens")).collect()):
        starts.append((part, before))
        before += total
    at = encoded.sparkSession.createDataFrame(starts, "part int, before long")
    upto = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    running = light.withColumn("within", F.coalesce(F.sum("n_tokens").over(upto), F.lit(0)))
    return running.join(F.broadcast(at), "part").select("row", (F.col("before") + F.col("within")).alias("place"))


def pack(docs: DataFrame, tokenizer: str = VOCABULARY, sequence: int = SEQUENCE, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Lay all documents one after the other along the curve and cut every `sequence` ids.

    One row per piece: doc_id, start (ids of its document before it), length,
    ids_crc32 (of little-endian unsigned 32-bit ids), doc_tokens, sequence_id, offset,
    n_padding (of its sequence: the last one is padded to the next power of two, all others are
    full), curve_key, and with_ids: ids. Each id lies in exactly one piece; a sequence's
    pieces have gapless offsets from 0.

    Null or empty text: end_id alone. Null doc_id: kept, first among equal keys. Repeated rows: packed as
    often as they stand there. Empty table: no rows. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    encoded = written(encode_documents(docs, tokenizer, end_id), "ids")
    total = encoded.agg(F.sum("n_tokens")).first()[0] or 0
    last, rest = divmod(total, sequence)
    padding = (1 << math.ceil(math.log2(rest))) - rest if rest else 0
    padding = min(padding, sequence - rest)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = "<u2" if tokens.encoder(tokenizer).size <= 1 << 16 else "<u4"
        for b in batches:
            doc, key, place, blobs = (b.column(n).to_pylist() for n in ("doc_id", "curve_key", "place", "ids"))
            out: list[tuple] = []
            for d, k, p, blob in zip(doc, key, place, blobs, strict=True):
                ids = np.frombuffer(blob, kind).astype("<u4")
                at = 0
                while at < ids.size:
                    s, o = divmod(p + at, sequence)
                    piece = ids[at : at + sequence - o].tobytes()
                    out.append((d, at, len(piece) // 4, zlib.crc32(piece), ids.size, s, o, padding if s == last else 0, k, *([piece] if with_ids else [])))
                    at += sequence - o
            columns = list(zip(*out, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, columns, strict=True)], names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "n_padding", "curve_key", *(["ids"] if with_ids else [])]
    placed = encoded.select("row", "doc_id", "curve_key", "ids").join(curve_offsets(encoded), "row")
    return placed.drop("row").mapInArrow(cut, ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names))
