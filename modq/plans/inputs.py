"""The operators' inputs, derived from the given tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modq.operators import chat
from modq.session import table

#: Fixed values of the keyword list that the queries use.
KEYWORDS = ("# words", "Idiot", "loser", "wheheat", "thhati er")

SAMPLES_SQL = """samples AS (
  SELECT d.lang AS profile, d.doc_id + 1 AS id, d.text, CASE WHEN l.toxic = 0 THEN 0 ELSE 1 END AS label,
    CASE WHEN d.doc_id % 7 = 0 THEN NULL WHEN d.doc_id % 5 = 0 THEN 'unknown' ELSE d.source END AS category,
    TIMESTAMP '2024-01-01 00:00:00' + d.doc_id * INTERVAL 1 HOUR AS created_at, md5(d.text) AS text_hash
  FROM documents d JOIN labels l USING (doc_id))"""

KEYWORDS_SQL = """keywords AS (
  SELECT * FROM (VALUES (1, 'Idiot', 'idiot'), (2, 'loser', 'loser'), (3, 'wheheat', 'wheheat'), (4, 'thhati er', 'thhati er')) AS t(pos, original, normalized))"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    category = F.when(F.col("doc_id") % 7 == 0, F.lit(None)).when(F.col("doc_id") % 5 == 0, "unknown").otherwise(F.col("source"))
    at = F.expr("CAST('2024-01-01 00:00:00' AS timestamp_ntz) + make_dt_interval(0, CAST(doc_id AS int))")
    return d.join(labels, "doc_id").select(F.col("lang").alias("profile"), (F.col("doc_id") + 1).alias("id"), "text", F.when(F.col("toxic") == 0, 0).otherwise(1).alias("label"), category.alias("category"), at.alias("created_at"), F.md5("text").alias("text_hash"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("profile"), "text")


def keywords(spark: SparkSession) -> DataFrame:
    from modq.sources.tables import keywords_of

    return keywords_of(spark.createDataFrame(list(enumerate(KEYWORDS)), "pos int, line string"))


def conversation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of conversations as one text block of a request."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("request_id"), F.col("turn").cast("int").alias("msg_seq"), F.lit(0).alias("block_seq"), "role", F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"))


def requests(spark: SparkSession, sf_dir: str, dialect: str) -> DataFrame:
    rows = chat.chat_export(conversation_blocks(spark, sf_dir), dialect)
    return rows.withColumn("dialect", F.lit(dialect)).withColumn("headers", F.create_map().cast("map<string,string>")).withColumn("profile", F.lit("p"))


def all_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for d in chat.DIALECTS:
        rows = requests(spark, sf_dir, d).withColumn("request_id", F.concat(F.lit(f"{d}:"), "request_id"))
        out = rows if out is None else out.unionByName(rows)
    return out


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as response bodies of the four dialects."""
    said = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    quoted = F.expr("substring(to_json(array(text)), 2, length(to_json(array(text))) - 2)")
    shapes = {
        "openai_chat": ('{"choices":[{"message":{"role":"assistant","content":', '},"finish_reason":"stop"}],"usage":{"prompt_tokens":3,"completion_tokens":4,"total_tokens":7}}'),
        "claude_chat": ('{"content":[{"type":"text","text":', '}],"stop_reason":"end_turn","usage":{"input_tokens":3,"output_tokens":4}}'),
        "openai_responses": ('{"object":"response","status":"completed","output":[{"type":"message","content":[{"type":"output_text","text":', '}]}],"usage":{"input_tokens":3,"output_tokens":4,"total_tokens":7}}'),
        "gemini_chat": ('{"candidates":[{"content":{"parts":[{"text":', '}]},"finishReason":"STOP"}],"usageMetadata":{"promptTokenCount":3,"candidatesTokenCount":4}}'),
    }
    out = None
    for d, (head, tail) in shapes.items():
        rows = said.select(F.concat_ws(":", F.lit(d), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("response_id"), F.lit(d).alias("dialect"), F.concat(F.lit(head), quoted, F.lit(tail)).alias("body"))
        out = rows if out is None else out.unionByName(rows)
    return out


def stream_chunks(spark: SparkSession, sf_dir: str, piece: int = 400, cut: int = 1000) -> DataFrame:
    """Assistant turns as event streams of the chat dialect: pieces of text in frames, cut again off the frames."""
    said = table(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("stream_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))
    frames = F.transform(parts, lambda p: F.concat(F.lit('data: {"choices":[{"index":0,"delta":{"content":'), F.substring(F.to_json(F.array(p)), F.lit(2), F.length(F.to_json(F.array(p))) - 2), F.lit("}}]}\n\n")))
    end = 'data: {"choices":[{"index":0,"delta":{},"finish_reason":"stop"}]}\n\ndata: [DONE]\n\n'
    body = said.select("stream_id", F.concat(F.array_join(frames, ""), F.lit(end)).alias("body"))
    return body.select("stream_id", F.lit("openai_chat").alias("dialect"), F.posexplode(F.regexp_extract_all("body", F.lit(f"(?s).{{1,{cut}}}"), F.lit(0))).alias("seq", "chunk")).withColumn("seq", F.col("seq").cast("long"))
