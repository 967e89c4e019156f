"""Substring dedup over a log-structured fingerprint index."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modq.llm.words import Words, long_list, mix, rows_of, slices
from modq.session import delete, file_system, fresh_path, prepare, release, written

WINDOW, ANCHOR = 13, 5
#: Windows that are compared in a task's memory before they are shuffled.
SETTLE_ROWS = 1 << 19
#: Rows of a fingerprint that each task of a batch puts in lot 0 before it deals the others over further lots.
FEW = 16
#: Word sequences whose least document is broadcast, at most.
MOST_HEADS = 4096
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def bucketed(rows: DataFrame, name: str, path: str, buckets: int, keys: list[str], sort: bool = False) -> DataFrame:
    """rows written to path as a table that is dealt into buckets by keys, and read back."""
    writer = rows.write.bucketBy(buckets, *keys)
    (writer.sortBy(*keys) if sort else writer).option("compression", "zstd").option("path", path).format("parquet").saveAsTable(name)
    return rows.sparkSession.table(name)


def forget(spark: SparkSession, name: str, path: str) -> None:
    """Drop a table that bucketed() wrote, with its files."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    delete(spark, path)


def dealt(fingerprints: DataFrame, lots: int) -> DataFrame:
    """hash, lot, doc_id of fingerprints (hash, doc_id), so that a very frequent one fills no bucket.

    In each task, the FEW smallest documents of a fingerprint are of lot 0 and all others of lots 1 to `lots`, by
    doc_id. So lot 0 tells whether several documents have a fingerprint, with at most FEW rows a task. Lots follow from a
    task's rows, not from their order, and are the same when a lost task is run again.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None, 0)  # hash, document and place of the last row
        for batch in batches:
            if not batch.num_rows:
                continue
            value, doc = (batch.column(i).to_numpy() for i in (0, 1))
            same = np.zeros(value.size, bool)  # as the row before
            same[1:] = (value[1:] == value[:-1]) & (doc[1:] == doc[:-1])
            same[0] = (value[0], doc[0]) == last[:2]
            begins = np.ones(value.size, bool)
            begins[1:] = value[1:] != value[:-1]
            place = np.cumsum(~same)
            group = np.cumsum(begins) - 1
            place = place - (place - ~same)[begins][group]  # from 1 within a fingerprint
            if value[0] == last[0]:
                place += np.where(group == 0, last[2], 0)
            last = (value[-1], doc[-1], int(place[-1]))
            lot = np.where(place <= FEW, 0, 1 + (mix(doc.view(np.uint64)) % np.uint64(lots)).astype(np.int64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x[~same]) for x in (value, lot, doc)], names=["hash", "lot", "doc_id"])

    return fingerprints.select("hash", "doc_id").sortWithinPartitions("hash", "doc_id").mapInArrow(deal, "hash long, lot int, doc_id long")


class FingerprintIndex:
    """Sorted immutable runs of window fingerprints (hash, lot, doc_id), each a bucketed table sorted by hash and lot, in one shared folder.

    append() writes one run per batch; shared() merge-joins a run's lot 0 with that of all runs, bucket by bucket, without a
    shuffle of history; compact() merges the runs into one once there are more than max_runs. A run is
    never changed: a lost executor only repeats the reading or writing of some buckets. The runs in force are named by the last
    of the folder's manifests, each written after its runs: an unfinished run is in none. open() finds the runs from any session.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None, max_runs: int = 1):
        self.spark, self.folder = spark, folder or fresh_path(spark, "fingerprints")
        self.buckets = buckets or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.runs: list[str] = []
        self.made, self.saved, self.max_runs = 0, 0, max_runs

    @classmethod
    def open(cls, spark: SparkSession, folder: str, max_runs: int = 1) -> FingerprintIndex:
        """The index of a folder as its last manifest names it."""
        fs, at = file_system(spark, folder)
        last = max(f.getPath().getName() for f in fs.listStatus(at) if f.getPath().getName().startswith("manifest-"))
        said = json.loads(spark.read.text(f"{folder}/{last}", wholetext=True).first()[0])
        index = cls(spark, folder, said["buckets"], max_runs)
        index.runs, index.made, index.saved = said["runs"], said["made"], said["saved"]
        for run in index.runs:
            spark.sql(f"CREATE TABLE IF NOT EXISTS {run} (hash BIGINT, lot INT, doc_id BIGINT) USING parquet CLUSTERED BY (hash, lot) SORTED BY (hash, lot) INTO {index.buckets} BUCKETS LOCATION '{folder}/{run}'")
        return index

    def _write(self, rows: DataFrame) -> str:
        run = f"run_{uuid.uuid4().hex}"
        self.made += 1
        bucketed(rows, run, f"{self.folder}/{run}", self.buckets, ["hash", "lot"], sort=True)
        return run

    def _save(self) -> None:
        self.saved += 1
        fs, at = file_system(self.spark, f"{self.folder}/manifest-{self.saved:09d}.json")
        out = fs.create(at, False)
        out.write(bytearray(json.dumps({"runs": self.runs, "buckets": self.buckets, "made": self.made, "saved": self.saved}).encode()))
        out.close()

    def append(self, fingerprints: DataFrame) -> str:
        """A batch's fingerprints (hash, doc_id; neither null) become a run."""
        run = self._write(dealt(fingerprints, self.buckets).repartition(self.buckets, "hash", "lot"))
        self.runs.append(run)
        self._save()
        return run

    def rows(self, runs: list[str] | None = None) -> DataFrame:
        tables = [self.spark.table(r) for r in (self.runs if runs is None else runs)]
        out = tables[0]
        for t in tables[1:]:
            out = out.union(t)
        return out

    def shared(self, run: str) -> DataFrame:
        """hash: fingerprints of this run that another document of this or an earlier run has too."""
        # a fingerprint with rows in other lots has several documents in lot 0 too
        bounds = [self.spark.table(r).where("lot = 0").groupBy("hash", "lot").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")) for r in self.runs[: self.runs.index(run) + 1]]
        own = bounds[-1]
        found = own.where("low <> high").select("hash")
        for earlier in bounds[:-1]:
            found = found.union(own.join(earlier.select("hash", "lot"), ["hash", "lot"], "left_semi").select("hash"))
        return found

    def having(self, hashes: DataFrame) -> DataFrame:
        """The index's rows of some fingerprints (hash, each once). Only hashes and lots move, the rows stay in their buckets."""
        rows = self.rows()
        lots = rows.where("lot > 0").select("hash", "lot").distinct().join(hashes, "hash", "left_semi")
        return rows.join(hashes.select("hash", F.lit(0).alias("lot")).union(lots), ["hash", "lot"], "left_semi")

    def compact(self) -> None:
        if len(self.runs) > self.max_runs:
            run = self._write(self.rows().distinct())  # bucket by bucket, as all runs are dealt by hash and lot
            old, self.runs = self.runs, [run]
            self._save()
            for r in old:
                forget(self.spark, r, f"{self.folder}/{r}")

    def drop(self) -> None:
        for r in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {r}")
        delete(self.spark, self.folder)
        self.runs = []


def anchors_of(words: Words, window: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed anchors of each text: of the `size`-word hashes inside every window, the least, rightmost.

    Equal windows have equal anchors. Returns the anchors' hashes and first words, ascending.
    """
    hashes, at = words.windows(words.hashes(), size)
    span = window - size + 1
    if hashes.size < span:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, span)
    starts, last = at[: views.shape[0]], at[span - 1 :]
    whole = np.flatnonzero(last - starts == span - 1)  # windows that lie in one text
    least = np.empty(whole.size, np.int64)
    for i in range(0, whole.size, 1 << 16):
        least[i : i + (1 << 16)] = whole[i : i + (1 << 16)] + span - 1 - np.argmin(views[whole[i : i + (1 << 16)], ::-1], axis=1)
    if least.size:
        chosen = np.zeros(hashes.size, bool)
        chosen[least] = True
        least = np.flatnonzero(chosen)
    return hashes[least], at[least]


def profiles(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """doc_id, text_key, n_words, words_sha, anchors (distinct hashes): one row per row of docs."""
    schema = "doc_id long, text_key long, n_words long, words_sha string, anchors array<long>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offs in slices(batch, "text"):
                w = Words(data, offs)
                hashes, at = anchors_of(w, window, anchor)
                bounds = np.searchsorted(at, w.first)
                lists = [np.unique(hashes[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
                sha = [hashlib.sha256(w.joined(data, a, b)).hexdigest() for a, b in zip(w.first, w.first[1:], strict=False)]
                flat = np.concatenate(lists)
                yield pa.RecordBatch.from_arrays([*rows_of(batch, ["doc_id", "text_key"], first, end), pa.array(w.counts(), pa.int64()), pa.array(sha), long_list(flat, np.array([len(x) for x in lists]))], names=["doc_id", "text_key", "n_words", "words_sha", "anchors"])

    return docs.mapInArrow(scan, schema)


def settled(doc: np.ndarray, one: np.ndarray, two: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Rows of windows, at most one for each window and one for each document, with a list of their first words in `at`.

    Not known: a window's least document of these rows. Known: all windows of a document that a smaller one
    of these rows has too; they need no other rows to be judged, so their fingerprint is replaced. So a window of very
    many documents, or one that a document repeats very often, doesn't bring all its rows to one task.
    """
    order = np.lexsort((at, doc, two, one))
    doc, one, two, at = doc[order], one[order], two[order], at[order]
    begins = np.ones(doc.size, bool)
    begins[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    known = doc > doc[begins][np.cumsum(begins) - 1]
    one, two = np.where(known, mix(doc.view(np.uint64)), one), np.where(known, np.uint64(0), two)
    order = np.lexsort((two, one, known))
    doc, one, two, at, known = doc[order], one[order], two[order], at[order], known[order]
    begins[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (doc[1:] != doc[:-1]) | (known[1:] != known[:-1])
    lists = pa.ListArray.from_arrays(pa.array(np.append(np.flatnonzero(begins), doc.size).astype(np.int32)), pa.array(at))
    return pa.RecordBatch.from_arrays([pa.array(doc[begins]), pa.array(one[begins].view(np.int64)), pa.array(two[begins].view(np.int64)), lists, pa.array(known[begins])], names=["doc_id", "one", "two", "at", "known"])


def candidate_windows(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """doc_id, one, two (128-bit window fingerprint: two hashes of independent word hashes), at (first words), known (as in settled())
    for windows that cover one of their document's shared anchors; docs: doc_id, text_key, text, shared."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n_waiting = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for first, end, data, offs in slices(batch, "text"):
                w = Words(data, offs)
                word = w.hashes()
                hashes, at = w.windows(word, anchor)
                shared = batch.column("shared").slice(first, end - first)
                values = np.asarray(shared.flatten().to_numpy(zero_copy_only=False)).view(np.uint64)
                doc_of = np.searchsorted(w.first, at, "right") - 1
                hit = np.zeros(len(w) + 1, np.int64)
                sizes = np.array([len(x) for x in shared])
                lo = np.concatenate([[0], np.cumsum(sizes)])
                edges = np.searchsorted(doc_of, np.arange(end - first + 1))
                for d in np.flatnonzero(sizes):
                    a, b = edges[d], edges[d + 1]
                    found = at[a:b][np.isin(hashes[a:b], values[lo[d] : lo[d + 1]])]
                    # windows that cover the anchor start from found - (window - anchor) to found
                    np.add.at(hit, np.maximum(found - (window - anchor), w.first[d]), 1)
                    np.add.at(hit, found + 1, -1)
                covered = np.cumsum(hit)[:-1] > 0
                one, starts = w.windows(word, window)
                two, _ = w.windows(w.hashes(1), window, salt=1)
                keep = np.flatnonzero(covered[starts])
                doc = np.searchsorted(w.first, starts[keep], "right") - 1
                waiting.append((ids[first + doc], one[keep], two[keep], (starts[keep] - w.first[doc]).astype(np.int32)))
                n_waiting += keep.size
                if n_waiting >= SETTLE_ROWS:
                    yield settled(*map(np.concatenate, zip(*waiting, strict=True)))
                    waiting, n_waiting = [], 0
        if n_waiting:
            yield settled(*map(np.concatenate, zip(*waiting, strict=True)))

    return docs.select("doc_id", "text", "shared").mapInArrow(scan, "doc_id long, one long, two long, at array<int>, known boolean")


def removed(docs: DataFrame, window: int, with_text: bool) -> DataFrame:
    """Cut the words that repeated windows cover; docs: doc_id, text_key, text, starts (their first words)."""
    names = ["doc_id", "text_key", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offs in slices(batch, "text"):
                w = Words(data, offs)
                gone, sha, texts = [], [], []
                starts = batch.column("starts").slice(first, end - first)
                for d, at in enumerate(starts):
                    n = int(w.first[d + 1] - w.first[d])
                    cover = np.zeros(n + 1, np.int64)
                    values = np.array(at.values.to_numpy()) if at.is_valid else np.zeros(0, np.int64)
                    np.add.at(cover, values, 1)
                    np.add.at(cover, values + window, -1)
                    keep = np.cumsum(cover)[:n] == 0
                    kept = w.joined(data, int(w.first[d]), int(w.first[d + 1]), keep)
                    gone.append(n - int(keep.sum()))
                    sha.append(hashlib.sha256(kept).hexdigest())
                    texts.append(kept.decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([*rows_of(batch, ["doc_id", "text_key"], first, end), pa.array(gone, pa.int64()), pa.array(sha), *([pa.array(texts, pa.string())] if with_text else [])], names=names)

    schema = "doc_id long, text_key long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return docs.select("doc_id", "text_key", "text", "starts").mapInArrow(scan, schema)


def with_heads(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text_key, n_words, words_sha) with head: the least doc_id of their word sequence, null where no other row has it.

    The heads of sequences of more than 1/MOST_HEADS of all rows, which are fewer than MOST_HEADS, are broadcast; rows
    of a large group of copies stay where they are. All others are joined by a shuffle.
    """
    key = ["words_sha", "n_words"]
    heads = rows.where("doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("head"), F.count("*").alias("n")).where("n > 1")
    heads = written(heads, "copied")
    large = F.col("n") > F.lit(rows.count() / MOST_HEADS)
    split = rows.join(F.broadcast(heads.where(large).select(*key, F.col("head").alias("large_head"))), key, "left")
    of_large = split.where("large_head is not null").withColumnRenamed("large_head", "head")
    others = split.where("large_head is null").drop("large_head").join(heads.where(~large).select(*key, "head"), key, "left")
    return of_large.unionByName(others)


def dedup(docs: DataFrame, index: FingerprintIndex | None = None, history: DataFrame | None = None, batches: int = 2, window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, with_text: kept_text, for every row of docs.

    Words are runs of bytes other than 0x20 and 0x09-0x0D. A window is `window` consecutive words. Each
    word goes that a window covers which also stands in a document with a smaller doc_id, of docs or
    of `history` (whose fingerprints `index` holds). Windows are judged on the input. Kept words are joined by one space.

    1. Every text's anchors (winnowed `anchor`-word hashes, one at least in each window) form
       `batches` batches by doc_id; each becomes a sorted run of the index, is merge-joined with the runs
       before it and itself, and runs are compacted. Copies of a smaller document's word sequence
       go whole without an index.
    2. Documents with a shared anchor are verified: all their windows over a shared anchor get
       128-bit fingerprints, grouped by their least doc_id. Words themselves aren't sent: two different windows count as
       one with a chance of 2**-128.
    3. Windows of a larger doc_id are cut.

    Null or empty text: no words, the SHA-256 of nothing. Null doc_id: never smaller nor larger than
    another, so kept whole. doc_id is a key; repeated rows get the same result each. Empty table: no rows. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    own = index is None
    index = index or FingerprintIndex(spark)
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
    seen = written(profiles(keyed, window, anchor), "profiles")
    seen_heads = with_heads(seen.select("doc_id", "text_key", "n_words", "words_sha"))
    plain = written(seen_heads.withColumn("copy", (F.col("n_words") >= window) & F.coalesce(F.col("doc_id") > F.col("head"), F.lit(False))), "heads")
    first = seen.join(plain.where("not copy and doc_id is not null").select("doc_id", "text_key").distinct(), ["doc_id", "text_key"], "left_semi")
    prints = first.select("doc_id", F.explode("anchors").alias("hash"))
    edges = first.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    shared, founds = None, []
    for i in range(len(edges) + 1):
        part = prints
        if i > 0:
            part = part.where(F.col("doc_id") > edges[i - 1])
        if i < len(edges):
            part = part.where(F.col("doc_id") <= edges[i])
        run = index.append(part)
        founds.append(written(index.shared(run), "shared"))
        shared = founds[-1] if shared is None else shared.union(founds[-1])
    release(seen)
    shared = shared.distinct()
    index.compact()
    hits = index.having(shared).groupBy("doc_id").agg(F.collect_set("hash").alias("shared"))
    everything = keyed if history is None else keyed.union(history.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text"))
    touched = everything.join(hits, "doc_id")  # text moves once: the table is bucketed by document for what follows
    buckets = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    store, place = f"touched_{uuid.uuid4().hex}", fresh_path(spark, "touched")
    touched = bucketed(touched, store, place, buckets, ["doc_id"])
    release(*founds)
    if own:
        index.drop()
    # one shuffle by fingerprint; a fingerprint's rows stay where they are while its least document is found
    windows = candidate_windows(touched, window, anchor).withColumn("low", F.min("doc_id").over(Window.partitionBy("known", "one", "two")))
    starts = windows.where("known or doc_id > low").groupBy("doc_id").agg(F.flatten(F.collect_list("at")).alias("starts"))
    cut = removed(touched.join(starts, "doc_id"), window, with_text).dropDuplicates(["doc_id", "text_key"])
    cut = written(cut, "cut")
    forget(spark, store, place)
    result = plain.join(cut, ["doc_id", "text_key"], "left")
    gone = F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    sha = F.when(F.col("copy"), F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "words_sha"))
    out = result.select("doc_id", "text_key", "n_words", gone.cast("long").alias("n_removed"), sha.alias("kept_sha256"), *(["copy", "kept_text"] if with_text else []))
    if with_text:
        whole = keyed.select("doc_id", "text_key", F.array_join(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), " ").alias("words")).dropDuplicates(["doc_id", "text_key"])
        out = out.join(whole.withColumnRenamed("doc_id", "d").withColumnRenamed("text_key", "k"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left")
        out = out.withColumn("kept_text", F.when(F.col("copy"), "").otherwise(F.coalesce("kept_text", "words"))).drop("copy", "words", "d", "k")
    return out.drop("text_key")
