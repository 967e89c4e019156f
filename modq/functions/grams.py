"""Hashed n-grams of whole texts, vectorised over Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modq.functions import text as T

#: Bytes of text whose n-grams are in memory at once, but for one longer text.
SLICE_BYTES = 1 << 16


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of a string column; null counts as empty."""
    col = pc.fill_null(column.cast(pa.large_string()), "")
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(col):
        end = min(len(col), max(int(np.searchsorted(offs, offs[row] + SLICE_BYTES, "right")) - 1, row + 1))
        yield row, end, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def spans(data: np.ndarray, offs: np.ndarray, least: int, most: int, words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and text of every run of least to most code points, or words between single spaces, that lies in one text."""
    if words:
        inside, edge = data != 0x20, np.zeros(data.size + 1, bool)
        edge[offs] = True
        first = np.flatnonzero(inside & (edge[:-1] | ~np.append(False, inside)[:-1]))
        last = np.flatnonzero(inside & (edge[1:] | ~np.append(inside, False)[1:])) + 1
    else:
        first = np.flatnonzero((data & 0xC0) != 0x80)
        last = np.append(first[1:], data.size)[: first.size]
    text = np.searchsorted(offs, first, "right") - 1
    starts, ends, owners = [], [], []
    for n in range(least, most + 1):
        k = first.size - n + 1
        if k > 0:
            whole = text[:k] == text[n - 1 :]
            starts.append(first[:k][whole])
            ends.append(last[n - 1 :][whole])
            owners.append(text[:k][whole])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *starts]), np.concatenate([none, *ends]), np.concatenate([none, *owners])


def hashed(data: np.ndarray, offs: np.ndarray, ngrams: tuple[int, int], words: bool, n_features: int, norm: str | None, alternate_sign: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, bucket and value of all non-zero features of a slice, by text and bucket."""
    starts, ends, text = spans(data, offs, *ngrams, words)
    h = T.murmur3_spans(data, starts, ends).astype(np.int64)
    sign = np.where(h < 0, -1.0, 1.0) if alternate_sign else np.ones(h.size)
    code, which = np.unique(text * n_features + np.abs(h) % n_features, return_inverse=True)
    value = np.bincount(which, sign, minlength=code.size).astype(np.float64)  # of nothing, numpy counts in integers
    code, value = code[value != 0], value[value != 0]
    text = code // n_features
    if norm == "l2":
        value = value / np.sqrt(np.bincount(text, value * value, minlength=len(offs) - 1))[text]
    return text, code % n_features, value


def plain_text(lowercase: bool, words: bool):
    plain = T.clean_newlines(F.col("text"))
    plain = T.normalize_spaces(F.lower(plain) if lowercase else plain)
    return F.array_join(F.filter(F.split(plain, T.SPACES), lambda x: x != ""), " ") if words else plain


def hashed_vectors(texts: DataFrame, keep: list[str], n_features: int = 1 << 20, ngrams: tuple[int, int] = (2, 4), analyzer: str = "char", lowercase: bool = True, norm: str | None = "l2", alternate_sign: bool = True) -> DataFrame:
    """keep's columns of each row of texts and buckets (ascending), values: hashed n-gram counts of its text, divided by their length with norm l2.

    One pass without a shuffle. Null text: no features.
    """
    words = analyzer != "char"
    rows = texts.select(*keep, plain_text(lowercase, words).alias("plain"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keep).dtypes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offs in slices(batch.column("plain")):
                text, bucket, value = hashed(data, offs, ngrams, words, n_features, norm, alternate_sign)
                edges = pa.array(np.searchsorted(text, np.arange(end - first + 1)).astype(np.int32))
                kept = [batch.column(c).slice(first, end - first) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(edges, pa.array(bucket.astype(np.int32))), pa.ListArray.from_arrays(edges, pa.array(value))], names=[*keep, "buckets", "values"])

    return rows.mapInArrow(scan, f"{kinds}, buckets array<int>, values array<double>")


def hashed_sums(texts: DataFrame, weights: np.ndarray, key: str, n_features: int, ngrams: tuple[int, int] = (2, 4), analyzer: str = "char", lowercase: bool = True, norm: str | None = "l2", alternate_sign: bool = True) -> DataFrame:
    """key and s, the sum of weights[bucket] * value over each text's features, in one pass. weights has n_features values."""
    words = analyzer != "char"
    rows = texts.select(key, plain_text(lowercase, words).alias("plain"))
    shared = texts.sparkSession.sparkContext.broadcast(weights)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offs in slices(batch.column("plain")):
                text, bucket, value = hashed(data, offs, ngrams, words, n_features, norm, alternate_sign)
                sums = np.bincount(text, shared.value[bucket].astype(np.float64) * value, minlength=end - first).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(first, end - first), pa.array(sums)], names=[key, "s"])

    return rows.mapInArrow(scan, f"`{key}` {dict(rows.dtypes)[key]}, s double")
