"""Exact dedup over an extendible-hash index on shared files, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from modq.functions.text import ascii_lower
from modq.llm.linking import matching
from modq.session import fresh_path, release, written

#: Keys of a bucket, at most, unless their hashes are equal. A cluster takes more: the directory has a few slots a bucket.
CAPACITY = 1024
#: Bits by which the directory can grow with one count of the keys.
STEP = 12
BITS = 62
#: Groups of more than 1 / HOT of all rows are summed up in each task before they move: fewer than HOT hashes.
HOT = 4096


def normalised(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; null as the empty text."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(ascii_lower(text))


def node(h: Column, depth: int) -> Column:
    """The slot of a hash in a directory of this depth. Slots are numbered as in a heap: that of depth 0 is 1, slot s splits into 2 s and 2 s + 1."""
    return F.lit(1).cast("long") if depth == 0 else F.shiftrightunsigned(h, 64 - depth).bitwiseOR(F.lit(1 << depth))


def split(keys: DataFrame, capacity: int, bits: int) -> tuple[DataFrame, int]:
    """(written directory: slot, bucket, depth; its depth) for the distinct hashes h.

    A bucket, a slot of its own depth, is split while it has more than `capacity` keys; the directory
    doubles as often as its deepest bucket asks for, and slots below a shallower bucket share it. Keys are
    counted once for STEP doublings. Only counts of slots are kept, and the driver learns no more than whether any are overfull.
    """
    depth, found, over = 0, None, None
    while True:
        step = min(STEP, bits - depth)
        asked = keys if over is None else keys.join(over.withColumnRenamed("node", "over"), node(F.col("h"), depth) == F.col("over"), "left_semi")
        slots = asked.groupBy(node(F.col("h"), depth + step).alias("node")).agg(F.count("*").alias("n"))
        up = slots.select(F.explode(F.sequence(F.lit(0), F.lit(step))).alias("up"), "node", "n")
        counts = written(up.groupBy(F.expr("shiftright(node, up)").alias("node"), (F.lit(depth + step) - F.col("up")).alias("depth")).agg(F.sum("n").alias("n")), "slots")
        full = counts.where(F.col("n") > capacity)
        # the children of overfull slots, empty ones too; those that aren't overfull are buckets
        children = full.where(F.col("depth") < depth + step).select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("node") * 2, F.col("node") * 2 + 1)).alias("node"))
        if depth == 0:
            children = children.unionByName(counts.where("depth = 0").select("depth", "node"))
        last = depth + step == bits
        kept = children.join(full.where(F.col("depth") < depth + step) if last else full, ["depth", "node"], "left_anti")
        found = kept if found is None else found.unionByName(kept)
        over = full.where(F.col("depth") == depth + step).select("node")
        depth += step
        if last or not over.limit(1).count():
            break
    buckets = written(found, "buckets")
    deepest = buckets.agg(F.max("depth")).first()[0] or 0
    below = F.expr(f"sequence(shiftleft(node, {deepest} - depth), shiftleft(node + 1, {deepest} - depth) - 1)")
    return buckets.select(F.explode(below).alias("slot"), F.col("node").alias("bucket"), "depth"), deepest


def build(docs: DataFrame, path: str, capacity: int = CAPACITY, bits: int = BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(keyed, rows, entries) of docs' index under path, a folder that all executors share.

    keyed: doc_id, t (normalised text), h (the first `bits` bits of its 64-bit hash), a plan. rows: h, doc_id, n, a row per distinct pair,
    written. entries: what path/entries holds, sorted by bucket and hash in each file, a row per distinct text: bucket,
    h, chain (place among the texts of one hash, from 1), chained (their number), keep_id, group_size, text_sha256. path/directory: slot, bucket, depth.

    A task owns whole buckets, which are key ranges: texts of a bucket meet there, and texts of one hash are told apart by all
    their bytes. Groups of more than 1 / HOT of all rows are first summed up where they are read.
    """
    spark = docs.sparkSession
    h = F.xxhash64("t")
    keyed = docs.select("doc_id", normalised(F.col("text")).alias("t")).withColumn("h", h.bitwiseAND(F.lit(-1 << (64 - bits))))
    rows = written(keyed.groupBy("h", "doc_id").agg(F.count("*").alias("n")), "keys")
    hashes = written(rows.groupBy("h").agg(F.sum("n").alias("n")), "hashes")
    directory, deepest = split(hashes.select("h"), capacity, bits)
    directory.write.parquet(f"{path}/directory")
    directory = spark.read.schema(directory.schema).parquet(f"{path}/directory")
    total = hashes.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(hashes.where((F.col("n") > 1) & (F.col("n") * HOT > total)).select("h"))
    single = keyed.join(hot, "h", "left_anti").select("h", "t", F.lit(1).cast("long").alias("n"), "doc_id")
    summed = keyed.join(hot, "h", "left_semi").groupBy("h", "t").agg(F.count("*").alias("n"), F.max("doc_id").alias("doc_id"))
    found = matching(single.unionByName(summed).withColumn("slot", node(F.col("h"), deepest)), directory.select("slot", "bucket"), ["slot"])
    owned = found.select("bucket", "h", "t", "n", "doc_id").repartition("bucket")
    texts = owned.groupBy("bucket", "h", "t").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    light = texts.select("bucket", "h", "keep_id", "group_size", F.sha2("t", 256).alias("text_sha256"))
    same = Window.partitionBy("bucket", "h")
    entries = light.withColumn("chain", F.row_number().over(same.orderBy("text_sha256"))).withColumn("chained", F.count("*").over(same))
    entries.sortWithinPartitions("bucket", "h", "chain").write.parquet(f"{path}/entries")
    release(hashes)
    return keyed, rows, read_entries(spark, path)


ENTRY = "bucket bigint, h bigint, keep_id bigint, group_size bigint, text_sha256 string, chain int, chained bigint"


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """The entries of an index that was built under path."""
    return spark.read.schema(ENTRY).parquet(f"{path}/entries")


def exact_duplicates(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, bits: int = BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (doc_id, text), through an index under path (default: a new one).

    Texts are equal when identical after lower-casing A-Z; of equal ones the row with the largest doc_id stays. Rows find their
    entry by hash; where texts share a hash, by hash and all bytes.

    Null text: empty. Null doc_id: below all others; in a group without any id keep_id is null. Rows of one doc_id and text
    are one document repeated: one of them stays. Empty table: no rows. Other columns are ignored. doc_id is a long.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed, rows, entries = build(docs, path or fresh_path(docs.sparkSession, "exact-index"), capacity, bits)
    alone = entries.where("chained = 1").select("h", "keep_id", "group_size", "text_sha256")
    found = rows.join(alone, "h").select("doc_id", "n", "keep_id", "group_size", "text_sha256")
    collided = entries.where("chained > 1")
    if collided.limit(1).count():
        again = keyed.join(collided.select("h").distinct(), "h", "left_semi").groupBy("h", "t", "doc_id").agg(F.count("*").alias("n"))
        groups = again.groupBy("h", "t").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
        found = found.unionByName(again.join(groups, ["h", "t"]).select("doc_id", "n", "keep_id", "group_size", F.sha2("t", 256).alias("text_sha256")))
    copies = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return copies.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
