"""Near-duplicate documents from bottom-k sketches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modq.llm.linking import SKETCH, least_common, link, sketch_filter
from modq.llm.words import LOWER, Words, long_list, rows_of, slices
from modq.session import prepare, release, written

def lookups(threshold: int) -> int:
    """How many of the retained values, rarest first, are looked up: one more than may be of one set alone."""
    return SKETCH - least_common(threshold) + 1


def set_hashes(data: np.ndarray, offs: np.ndarray, words: int, seed: int = 0) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, ascending, of 63 bits, so that the order of signed longs is theirs."""
    w = Words(data, offs)
    word = w.hashes(seed)
    hashes, at = w.windows(word, words, salt=seed)
    hashes >>= np.uint64(1)
    bounds = np.searchsorted(at, w.first)
    for d, n in enumerate(w.counts()):
        if 0 < n < words:
            short, _ = Words(data[offs[d] : offs[d + 1]], np.array([0, offs[d + 1] - offs[d]])).windows(word[w.first[d] : w.first[d + 1]], int(n), salt=seed)
            yield np.unique(short >> np.uint64(1))
        else:
            yield np.unique(hashes[bounds[d] : bounds[d + 1]])


def shingle_sets(docs: DataFrame, words: int, lower: bool) -> DataFrame:
    """doc_id, n_shingles, digest (of the whole set, as two hashes of each shingle that rest on independent word hashes),
    sketch (its SKETCH smallest hashes), one per row of docs."""
    schema = "doc_id long, n_shingles long, digest binary, sketch array<long>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offs in slices(batch, "text"):
                sizes, digests, sketches = [], [], []
                bytes_ = LOWER[data] if lower else data
                for values, again in zip(set_hashes(bytes_, offs, words), set_hashes(bytes_, offs, words, 1), strict=True):
                    sizes.append(values.size)
                    digests.append(hashlib.blake2b(values.tobytes() + again.tobytes(), digest_size=16).digest())
                    sketches.append(values[:SKETCH])
                flat = np.concatenate(sketches) if sketches else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([*rows_of(batch, ["doc_id"], first, end), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), long_list(flat, np.array([len(s) for s in sketches]))], names=["doc_id", "n_shingles", "digest", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def shingles_of(text: str, words: int, lower: bool) -> set:
    """The set itself, for exact checks."""
    raw = text.encode("utf-8", "surrogatepass")
    found = (raw.lower() if lower else raw).split()
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def verifier(heads: DataFrame, texts: DataFrame, words: int, threshold: int, lower: bool):
    """Pairs a, b to those with 100 * intersection >= threshold * union on their full sets.

    heads: node, sketch; texts: node, text.
    """

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, kept = None, set()
        for b in batches:
            good = []
            for pivot, x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if pivot != name:
                    name, kept = pivot, shingles_of(y, words, lower)
                other = shingles_of(x, words, lower)
                common = len(kept & other)
                good.append(100 * common >= threshold * (len(kept) + len(other) - common))
            keep = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep)], names=["a", "b"])

    def verify(pairs: DataFrame) -> DataFrame:
        left = sketch_filter(heads, threshold)(pairs).join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
        both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
        return both.select("a", "b", "x", "y").mapInArrow(exact, "a long, b long")

    return verify


def hashed_sets(texts: DataFrame, words: int, lower: bool) -> DataFrame:
    """node, value: the hashed shingles of each text, each once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, offs in slices(batch, "text"):
                for d, values in enumerate(set_hashes(LOWER[data] if lower else data, offs, words)):
                    node = batch.column("node").take(pa.array(np.full(values.size, first + d)))
                    yield pa.RecordBatch.from_arrays([node, pa.array(values.view(np.int64))], names=["node", "value"])

    return texts.select("node", "text").mapInArrow(scan, "node long, value long")


def near_duplicates(docs: DataFrame, words: int = 5, threshold: int = 80, lower: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id = component_id), one per row of docs.

    A document's set: distinct shingles of `words` words (white space 0x20, 0x09-0x0D; A-Z lowered with
    lower); with fewer words, its whole sequence. Links: 100 * |A & B| >= threshold * |A | B|.
    component_id: the smallest doc_id that links reach.

    Documents with equal sets, by a digest of the whole set, are one class from the start. Every class keeps its set's SKETCH
    smallest values under one hash function. Two linked sets differ in more than lookups() - 1 of their
    retained values with a chance below 1e-6 (in none of the sets that are kept whole), so both have one in
    common among the lookups() rarest of the corpus: only these stand in the inverted lists, and values
    of one class in none. The union of two sketches estimates the similarity and drops pairs far
    below; the rest are compared on the full sets of their texts.

    Null or empty text, or white space alone: n_shingles 0, linked with nothing. Null doc_id: n_shingles
    counted, component_id null, kept, linked with nothing. doc_id is a key: repeated rows
    count as one document, and each gets its result. Empty table: no rows. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    sets = written(shingle_sets(docs, words, lower), "sets")
    usable = sets.where("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"))
    heads = classes.join(usable.select("digest", F.col("doc_id").alias("node"), "sketch").dropDuplicates(["digest", "node"]), ["digest", "node"])
    heads = written(heads.select("node", "n", "sketch"), "heads")
    retained = heads.select("node", "n", F.explode("sketch").alias("value"))
    shared = retained.groupBy("value").agg(F.count("*").alias("classes"))
    ranked = retained.join(shared, "value").withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("classes", "value")))
    room = F.when(F.col("n") > SKETCH, F.lit(lookups(threshold))).otherwise(F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1)
    # a text in the middle of its near copies has few values of its own and many that the others have
    ranked = ranked.withColumn("rank", -F.sum("classes").over(Window.partitionBy("node")))
    looked = ranked.where((F.col("place") <= room) & (F.col("classes") > 1))
    postings = written(looked.select("value", "node", "n", "rank"), "postings")
    texts = docs.where("doc_id is not null").select(F.col("doc_id").alias("node"), "text").join(postings.select("node").distinct(), "node", "left_semi")
    texts = written(texts.dropDuplicates(["node"]), "candidates")
    near = written(heads.join(postings.select("node").distinct(), "node", "left_semi").select("node", "sketch"), "sketches")


    def whole_sets(nodes: DataFrame) -> DataFrame:
        return hashed_sets(texts.join(nodes, "node", "left_semi"), words, lower)

    linked = link(postings, verifier(near, texts, words, threshold, lower), whole_sets, threshold)
    release(heads, postings, texts, near)
    heads_of = written(classes.select("digest", "node").join(linked, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id")), "classes")
    found = usable.select("doc_id", "n_shingles", "digest").join(heads_of, "digest").select("doc_id", "n_shingles", "component_id")
    # sets that link with nothing need no join
    out = found.unionByName(sets.where("not (n_shingles > 0 and doc_id is not null)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
