"""Structured Streaming forms of moderation, verdict reuse, the learning loop, stream reassembly and counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from modq.functions import text as T
from modq.functions.terms import token_scores
from modq.operators import moderate as M
from modq.operators import streams as S
from modq.operators.sample_table import append_new, upsert_counts
from modq.session import scratch
from modq.sources.versions import VersionedTable
from modq.streaming.state import FRAMES, VERDICTS, FrameAssembly, VerdictReuse, use_state_store


def moderate_stream(requests: DataFrame, keywords: DataFrame, scorer: Callable[[DataFrame], DataFrame], history: Callable[[], DataFrame], sink: str, checkpoint: str, queue: str | None = None, template: str = "{{text}}", **settings):
    """Start a query that decides every arriving micro-batch with moderate() and appends the decisions to sink, and with queue what waits for
    review (profile, text_hash, text, prompt, queued_at) there.

    Batches are written under their number, so that a repeated batch replaces itself; history() is read anew for each: a sample table's read()
    has all verdicts that learn_stream() has appended by then.
    """

    def each(batch: DataFrame, number: int) -> None:
        with scratch():
            done = M.moderate(batch, keywords, scorer, history(), **settings)
            done.write.mode("overwrite").parquet(f"{sink}/batch={number}")
            if queue is not None:
                decided = batch.sparkSession.read.parquet(f"{sink}/batch={number}")
                waiting = M.review_queue(decided, batch, template, settings.get("max_text", 4000))
                waiting.withColumn("queued_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{queue}/batch={number}")

    return requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def learn_stream(queue: DataFrame, verdicts: DataFrame, samples: VersionedTable, rejects: str, checkpoint: str, name: str = "learn", wait: str = "1 hour"):
    """Start a query that turns reviewers' verdicts into samples: the queue (profile, text_hash, text, queued_at) meets the verdicts (profile, text_hash,
    content, judged_at) that come at most `wait` after a text was queued, in either order; what parses is appended to samples, the rest goes to
    rejects.

    Watermarks of both sides bound the state. Samples of a batch are appended under its number, which the table's ledger keeps under name, so a
    repeated batch adds nothing. A text that one batch finds twice, queued or judged again, becomes one sample.
    """
    asked = queue.select("profile", "text_hash", "text", "queued_at").withWatermark("queued_at", wait)
    told = verdicts.select(F.col("profile").alias("own"), F.col("text_hash").alias("hash"), "content", "judged_at").withWatermark("judged_at", wait)
    met = asked.join(told, (F.col("profile") == F.col("own")) & (F.col("text_hash") == F.col("hash")) & (F.col("judged_at") >= F.col("queued_at")) & (F.col("judged_at") <= F.col("queued_at") + F.expr(f"interval {wait}")))

    def each(batch: DataFrame, number: int) -> None:
        with scratch():
            one = batch.groupBy("profile", "text_hash").agg(F.max_by(F.struct("text", "content"), F.struct("judged_at", "content")).alias("v")).select("profile", "text_hash", "v.*")
            good, bad = M.apply_verdicts(one.select("profile", "text_hash", "text"), one.select("profile", "text_hash", "content"))
            bad.write.mode("overwrite").parquet(f"{rejects}/batch={number}")
            append_new(samples, good, name, number)

    return met.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def local_decisions(requests: DataFrame, keywords: DataFrame, terms: DataFrame, intercept: float, low: float = 0.2, high: float = 0.8, max_text: int = 4000, review_rate: float = 0.0, seed: int = 42, error_code: str = M.ERROR_CODE) -> DataFrame:
    """requests (profile, text, more) with text_hash, decision, source, reason, p: moderate() as far as a row alone can be decided, so that it runs on a stream,
    too. No row meets another: keywords and terms go to every task and must be as few as moderate() takes there; what is open waits for review.
    """
    rows = M.keyword_block(requests.withColumn("text", F.coalesce("text", F.lit(""))), keywords, error_code)
    rows = rows.withColumn("text", T.truncate_middle(F.col("text"), max_text)).withColumn("text_hash", T.text_hash(F.col("text")))
    known = terms.select("term", (F.col("weight").cast("double") * F.col("idf")).alias("weight"))
    scored = token_scores(rows, T.ws_tokens(F.col("text")), known.toArrow())
    forced = F.lit(False) if review_rate <= 0 else M.unit_draw(seed, "text_hash") < review_rate
    scored = scored.withColumn("p", F.when(F.col("keyword").isNull() & ~forced, T.sigmoid(F.lit(float(intercept)) + F.col("s"))))
    done = M.decide(scored, low, high)
    rule, local = F.col("keyword").isNotNull(), F.col("decision").isin("allow", "block")
    return done.select(
        *requests.columns, "text_hash", F.when(rule, "block").when(local, F.col("decision")).otherwise("review").alias("decision"),
        F.when(rule, "keyword").when(local, "local").otherwise("review").alias("source"), F.when(rule, F.col("keyword_reason")).when(local, F.col("reason")).alias("reason"), "p",
    )


def reuse_verdicts_stream(decided: DataFrame, key: str = "id", ttl: str = "1 hour") -> DataFrame:
    """Every row of decided (key, profile, text_hash, decision, source, reason, p) with the verdict that its profile's text first had within ttl, and
    reused: whether that was another row's.

    A text's verdict is kept in the state store for ttl after it was made (processing time), so state is bounded by time; with the trigger
    availableNow use run_available(). Rows of one batch
    count in the order of their key. Texts are dealt by profile and two digits of their hash: a profile is many keys.
    """
    use_state_store(decided.sparkSession)
    kind = dict(decided.dtypes)[key]
    rows = decided.select("profile", F.left("text_hash", F.lit(2)).alias("shard"), F.col(key).alias("key"), "text_hash", "decision", "source", "reason", "p")
    out = rows.groupBy("profile", "shard").transformWithStateInPandas(VerdictReuse(ttl), f"key {kind}, {VERDICTS}", "append", "ProcessingTime")
    return out.withColumnRenamed("key", key)


def run_available(spark: SparkSession, writer, timers: bool = False) -> StreamingQuery:
    """Run a query over all that its sources have now, and wait for its end.

    timers: also run batches for timers alone, at the watermark's end; with processing time (reuse_verdicts_stream()) they would never end.
    """
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, str(timers).lower())
    try:
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(name, before)
    return query


def dedupe_texts_stream(texts: DataFrame, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """texts with one row per (profile, text hash) within the watermark's delay; state is bounded by time."""
    hashed = texts.withColumn("text_hash", T.text_hash(F.col("text")))
    return hashed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["profile", "text_hash"])


def frames_stream(chunks: DataFrame, idle: str = "10 minutes", first: int = 0) -> DataFrame:
    """stream_id, dialect, frame_seq, frame, complete: a stream's frames in order, given out at its end mark, or when the watermark says that it was idle
    too long.

    chunks: stream_id, seq (from `first`, without gaps), dialect, chunk, ts; cut anywhere, in any order. A stream ends with a frame whose data are [DONE], or
    one that ends its dialect, once no chunk before it is missing; text inside a frame's data ends nothing. Chunks after the end are left out.

    An arrival is parsed from where the last one ended: state holds finished frames, the pieces of the unfinished one and chunks that came
    too early, and none of them is read again for a new chunk. Times are epoch milliseconds, whatever the session's zone.
    """
    use_state_store(chunks.sparkSession)
    rows = chunks.withWatermark("ts", idle).select("stream_id", "seq", "dialect", "chunk", F.unix_millis("ts").alias("ms"), "ts")
    return rows.groupBy("stream_id").transformWithStateInPandas(FrameAssembly(idle, first), FRAMES, "append", "EventTime")


def reassemble_streams_stream(chunks: DataFrame, sink: str, checkpoint: str, idle: str = "10 minutes", first: int = 0):
    """Start a query that appends reassemble_streams()' rows to sink as streams end; equal to the batch result."""

    def each(batch: DataFrame, number: int) -> None:
        done = S.reassemble_streams(S.frames_to_events(S.parsed_frames(batch)))
        done.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return frames_stream(chunks, idle, first).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def running_counts_stream(samples: DataFrame) -> DataFrame:
    """profile, label, n, kept up to date; for update or complete mode."""
    return samples.groupBy("profile", "label").agg(F.count("*").alias("n"))


def upsert_counts_stream(samples: DataFrame, counts: VersionedTable, checkpoint: str, name: str = "counts"):
    """Start a query that keeps the totals of counts (profile, label, n): each batch writes the totals that it changed, and the profiles that have them, as a
    new version, so readers see a whole one; a repeated batch changes nothing."""

    def each(batch: DataFrame, number: int) -> None:
        upsert_counts(counts, batch, name, number)

    return running_counts_stream(samples).writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint)
