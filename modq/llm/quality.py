"""Quality scores from random-indexing word vectors and a small network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modq.llm.words import mix, powers, rows_of, slices
from modq.session import prepare, written

#: Word buckets, dimensions, non-zero entries of an index vector, neighbours on each side.
BUCKETS, DIMS, NONZERO, REACH = 1 << 13, 32, 2, 2
#: Labelled rows that the network is fitted on, at most (those with the smallest hash).
TRAIN_ROWS = 20_000
HIDDEN, EPOCHS, RATE, BATCH = 32, 60, 0.01, 128
FEATURES = 3 * DIMS + 4

#: Classes of bytes: 0 space, 1 letter (and all of UTF-8's longer sequences), 2 digit, 3 other.
CLASS = np.full(256, 3, np.uint8)
CLASS[[0x20, *range(0x09, 0x0E)]] = 0
CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
CLASS[48:58] = 2


def pieces(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each token and each text's first token. Tokens: runs of letters, runs of digits, single other characters."""
    n = data.size
    kind = CLASS[data]
    begin = np.zeros(n + 1, bool)
    begin[offs] = True
    if n:
        begin[1:n] |= (kind[1:] != kind[:-1]) | (kind[1:] == 3)
    edges = np.flatnonzero(begin)
    starts = edges[:-1] if edges.size and edges[-1] == n else edges
    ends = np.append(starts[1:], n)[: starts.size]
    real = kind[starts] != 0 if n else np.zeros(0, bool)
    starts, ends = starts[real], ends[real]
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    bucket = mix((total[ends] - total[starts]) * down[starts]) % np.uint64(BUCKETS)
    return bucket.astype(np.int64), np.searchsorted(starts, offs)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Each bucket's non-zero dimensions and their signs."""
    h = mix(np.arange(BUCKETS * NONZERO, dtype=np.uint64) + np.uint64(977)).reshape(BUCKETS, NONZERO)
    return (h % np.uint64(DIMS)).astype(np.int64), np.where(h >> np.uint64(63), 1, -1)


def context_counts(docs: DataFrame) -> DataFrame:
    """bucket, counts: sums of the index vectors of all neighbours within REACH, over all texts.

    Each task sums its texts into one matrix of BUCKETS x DIMS integers, so what is shuffled is bounded for a task
    whatever it reads, and the sums don't depend on their order.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, signs = index_vectors()
        sums = np.zeros(BUCKETS * DIMS, np.int64)
        seen = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, data, offs in slices(batch, "text"):
                bucket, first = pieces(data, offs)
                text = np.repeat(np.arange(len(offs) - 1), np.diff(first))
                seen += np.bincount(bucket, minlength=BUCKETS)
                for step in range(1, REACH + 1):
                    near = np.flatnonzero(text[step:] == text[:-step])
                    for a, b in ((near, near + step), (near + step, near)):
                        for k in range(NONZERO):
                            cell = bucket[a] * DIMS + dims[bucket[b], k]
                            sums += np.bincount(cell, signs[bucket[b], k], BUCKETS * DIMS).astype(np.int64)
        keep = np.flatnonzero(seen)
        flat = sums.reshape(BUCKETS, DIMS)[keep]
        rows = np.concatenate([seen[keep, None], flat], axis=1).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keep), *[pa.array(rows[:, j]) for j in range(DIMS + 1)]], names=["bucket", *[f"c{j}" for j in range(DIMS + 1)]])

    schema = "bucket long, " + ", ".join(f"c{j} long" for j in range(DIMS + 1))
    each = docs.select("text").mapInArrow(scan, schema)
    return each.groupBy("bucket").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(DIMS + 1)])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS x DIMS unit vectors of words (at most BUCKETS rows reach the driver), frequent words' signs damped by a root."""
    table = context_counts(docs).toPandas().to_numpy(np.int64)
    out = np.zeros((BUCKETS, DIMS), np.float32)
    for row in table[np.argsort(table[:, 0])]:
        context = row[2:].astype(np.float64)
        damped = np.sign(context) * np.sqrt(np.abs(context))
        out[row[0]] = damped / max(np.sqrt((damped**2).sum()), 1e-9)
    return out


def pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """doc_id, pool: each whole text's mean and deviation of its word vectors, the mean product of consecutive ones, and sizes."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # BUCKETS x DIMS floats: 1 MB at any input size

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            for start, end, data, offs in slices(batch, "text", 1 << 19):
                bucket, first = pieces(data, offs)
                n = np.diff(first)
                text = np.repeat(np.arange(n.size), n)
                some = np.flatnonzero(n)
                pool = np.zeros((n.size, FEATURES), np.float32)
                if some.size:
                    x = v[bucket]
                    count = np.maximum(n[some, None], 1)
                    mean = np.add.reduceat(x, first[some], axis=0) / count
                    square = np.add.reduceat(x * x, first[some], axis=0) / count
                    step = np.zeros_like(x)
                    step[:-1] = x[:-1] * x[1:] * (text[1:] == text[:-1])[:, None]
                    pool[some, :DIMS] = mean
                    pool[some, DIMS : 2 * DIMS] = np.sqrt(np.maximum(square - mean**2, 0))
                    pool[some, 2 * DIMS : 3 * DIMS] = np.add.reduceat(step, first[some], axis=0) / count
                    same = np.zeros(bucket.size, np.float32)
                    same[:-1] = (bucket[1:] == bucket[:-1]) & (text[1:] == text[:-1])
                    order = np.unique(text * BUCKETS + bucket) // BUCKETS
                    pool[some, -4] = np.add.reduceat(same, first[some]) / n[some]
                    pool[:, -3] = np.bincount(order, minlength=n.size) / np.maximum(np.sqrt(n), 1)
                    pool[:, -2] = np.log1p(n)
                    pool[:, -1] = np.log1p(np.diff(offs)) - np.log1p(n)
                yield pa.RecordBatch.from_arrays([*rows_of(batch, ["doc_id"], start, end), pa.FixedSizeListArray.from_arrays(pa.array(pool.ravel()), FEATURES).cast(pa.list_(pa.float32()))], names=["doc_id", "pool"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, pool array<float>")


@dataclass
class Network:
    """Standardised inputs, tanh units, one logit over a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Network:
    """Adam on the cross-entropy of a shuffled four fifths; the rest sets the temperature.

    With one label only, or no rows: a constant network of the smoothed share of label 1.
    """
    rng = np.random.default_rng(seed)
    d = FEATURES
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(d), np.ones(d))
    net = Network(mean, scale, rng.standard_normal((d, HIDDEN)) / np.sqrt(d), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), 0.0)
    if len(np.unique(y)) < 2:
        p = (y.sum() + 1) / (len(y) + 2)
        net.w2[:], net.b2 = 0, float(np.log(p / (1 - p)))
        return net
    order = rng.permutation(len(x))
    held, kept = order[: len(x) // 5], order[len(x) // 5 :]
    z = (x - mean) / scale
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        rng.shuffle(kept)
        for i in range(0, len(kept), BATCH):
            rows = kept[i : i + BATCH]
            h = np.tanh(z[rows] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40)))
            e = (p - y[rows]) / len(rows)
            back = np.outer(e, params[2]) * (1 - h**2)
            grads = [z[rows].T @ back + 1e-4 * params[0], back.sum(0), h.T @ e + 1e-4 * params[2], np.array([e.sum()])]
            t += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] -= RATE * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = *params[:3], float(params[3][0])
    if len(held):
        logits = net.logits(x[held])
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        loss = [np.mean(np.logaddexp(0, np.where(y[held] == 1, -1, 1) * logits / g)) for g in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def held_out(doc_id) -> "F.Column":
    """crc32 of the doc_id as text, modulo 3, is 1; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def score(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: quality 1 likelier), predicted (1 if score >= 0.5) for every row of docs.

    Word vectors: random indexing over all texts. The network learns from rows of labels (doc_id, quality)
    that aren't held out and have a document, each once, at most train_rows of them, those with the smallest hash of doc_id; scores
    use the text alone.

    Null or empty text: the pooled zero vector's score. Null doc_id: kept, never learned from.
    Null labels: left out. Repeated rows: one score each. Empty tables: no rows, or, without labels, 0.5 for all. Other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    pools = written(pooled(docs, word_vectors(docs)), "pools")
    marked = labels.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = pools.join(marked, "doc_id").groupBy("doc_id", "quality").agg(F.min("pool").alias("pool"))
    taken = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = taken.orderBy("doc_id").select("pool", "quality").toPandas()
    x = np.stack(rows["pool"]).astype(np.float64) if len(rows) else np.zeros((0, FEATURES))
    net = fit(x, rows["quality"].to_numpy(np.float64))
    shared = spark.sparkContext.broadcast(net)  # a few thousand numbers

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pool = np.asarray(b.column(1).flatten()).reshape(-1, FEATURES).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(shared.value.probabilities(pool), 9))], names=["doc_id", "score"])

    scored = pools.mapInArrow(scan, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
