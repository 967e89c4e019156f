"""The library's queries over the given tables, and their SQL; the llm subpackage keeps its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modq.functions import text as T
from modq.operators import chat, evaluate, grouped, moderate, profiles, store, streams, train
from modq.plans import inputs
from modq.plans.inputs import KEYWORDS_SQL, SAMPLES_SQL
from modq.session import fresh_path, prepare, small_batches, table, written
from modq.sources.tables import write_report

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Terms and samples of the training queries, at most: training's defaults.
MAX_TERMS, TRAIN = 8000, 50_000
TEMPLATE = "Judge this text: {{text}}"


def query(name: str, sql: str | None = None):
    def keep(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            small_batches(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


def on_documents(name: str, value, sql: str | None) -> None:
    """A scalar function over the whole texts of documents."""
    query(name, None if sql is None else f"SELECT doc_id, {sql} AS value FROM documents")(lambda spark, d: table(spark, d, "documents").select("doc_id", value(F.col("text")).alias("value")))


SPACE = r"'\s+'"
on_documents("a1_clean_newlines", T.clean_newlines, "translate(text, chr(13) || chr(10), '  ')")
on_documents("a2_normalize_spaces", T.normalize_spaces, f"regexp_replace(text, {SPACE}, ' ', 'g')")
on_documents("a3_lower", F.lower, "lower(text)")
on_documents("a3_ascii_lower", T.ascii_lower, f"translate(text, '{T.UPPER}', '{T.LOWER}')")
on_documents("a4_ws_tokens", lambda t: F.array_join(T.ws_tokens(t), "|"), f"array_to_string(list_filter(regexp_split_to_array(lower(text), {SPACE}), lambda x: x <> ''), '|')")
on_documents("a5_char_ngrams", lambda t: F.md5(F.array_join(T.char_ngrams(t, 2, 4), "|")), "(SELECT md5(array_to_string(list_concat([c[i] || c[i + 1] FOR i IN range(1, len(c))], [c[i] || c[i + 1] || c[i + 2] FOR i IN range(1, len(c) - 1)], [c[i] || c[i + 1] || c[i + 2] || c[i + 3] FOR i IN range(1, len(c) - 2)]), '|')) FROM (SELECT string_split(text, '') AS c))")
on_documents("a6_word_ngrams", lambda t: F.array_join(T.word_ngrams(t, 1, 2), "|"), f"(SELECT array_to_string(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]), '|') FROM (SELECT list_filter(regexp_split_to_array(text, {SPACE}), lambda x: x <> '') AS w))")
on_documents("a10_text_hash", T.text_hash, "md5(text)")
on_documents("a11_truncate_middle", lambda t: T.truncate_middle(t, 300), "CASE WHEN length(text) > 300 THEN left(text, 200) || chr(10) || '...[中间省略]...' || chr(10) || right(text, 100) ELSE text END")
on_documents("a12_render_prompt", lambda t: T.render_prompt(F.lit(TEMPLATE), t), "replace('Judge this text: {{text}}', '{{text}}', replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;'))")
#: Documents hold no CJK: these get some, more or less by their length.
CJK = lambda t: F.concat(F.repeat(F.lit("語𠀀"), F.length(t) % 7), t)
CJK_SQL = "repeat('語𠀀', (length(text) % 7)::BIGINT) || text"
on_documents("a13_estimate_tokens", lambda t: T.estimate_tokens(CJK(t)), rf"(SELECT CASE WHEN t = '' THEN NULL ELSE greatest(1, ceil(0.28::DOUBLE * (length(t) - s - c) + 1.4::DOUBLE * c + 0.15::DOUBLE * s + 4.0::DOUBLE))::BIGINT END FROM (SELECT t, len(regexp_extract_all(t, '\s')) AS s, length(t) - length(replace(replace(t, '語', ''), '𠀀', '')) AS c FROM (SELECT regexp_replace({CJK_SQL}, '^\s+|\s+$', '', 'g') AS t)))")


#: MurmurHash3 x86 32, seed 0, of the distinct strings gram of a table g, signed, as a table hashed (gram, h).
MURMUR_SQL = """
bytes AS (SELECT gram, hex(encode(gram)) AS x, octet_length(encode(gram)) AS n FROM g),
blocks AS (SELECT gram, n, [('0x' || rpad(substr(y, 7, 2), 2, '0') || rpad(substr(y, 5, 2), 2, '0') || rpad(substr(y, 3, 2), 2, '0') || substr(y, 1, 2))::UBIGINT FOR y IN [substr(x, 8 * i + 1, 8) FOR i IN range(0, ((n + 3) // 4)::BIGINT)]] AS v FROM bytes),
once AS (SELECT gram, n, [(a * 3432918353) % 4294967296 FOR a IN v] AS v FROM blocks),
mixed AS (SELECT gram, n, [((((a << 15) | (a >> 17)) & 4294967295) * 461845907) % 4294967296 FOR a IN v] AS v FROM once),
folded AS (SELECT gram, n, v, list_reduce(list_prepend(0::UBIGINT, v[1:(n // 4)::BIGINT]), lambda h, k: ((((xor(h, k) << 13) | (xor(h, k) >> 19)) & 4294967295) * 5 + 3864292196) % 4294967296) AS h FROM mixed),
tailed AS (SELECT gram, xor(CASE WHEN n % 4 > 0 THEN xor(h, v[-1]) ELSE h END, n::UBIGINT) AS h FROM folded),
final1 AS (SELECT gram, (xor(h, h >> 16) * 2246822507) % 4294967296 AS h FROM tailed),
final2 AS (SELECT gram, (xor(h, h >> 13) * 3266489909) % 4294967296 AS h FROM final1),
hashed AS MATERIALIZED (SELECT gram, CASE WHEN h >= 2147483648 THEN h::BIGINT - 4294967296 ELSE h::BIGINT END AS h FROM (SELECT gram, xor(h, h >> 16) AS h FROM final2))"""


@query("a7_hash_bucket", rf"""WITH g AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), {SPACE}), lambda x: x <> '')) AS gram FROM documents), {MURMUR_SQL}
SELECT gram, (abs(h) % 1048576)::INT AS bucket, CASE WHEN h < 0 THEN -1 ELSE 1 END AS sign FROM hashed""")
def _(spark, d):
    grams = table(spark, d, "documents").select(F.explode(T.ws_tokens(F.col("text"))).alias("gram")).distinct()
    return grams.select("gram", T.hash_bucket(F.col("gram"), 1 << 20).alias("b")).select("gram", "b.bucket", "b.sign")


@query("a8_l2_normalize", rf"""WITH t AS (SELECT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), {SPACE}), lambda x: x <> '')) AS gram FROM documents), g AS (SELECT DISTINCT gram FROM t), {MURMUR_SQL},
c AS (SELECT id, (abs(h) % 1048576)::INT AS bucket, sum(CASE WHEN h < 0 THEN -1 ELSE 1 END)::DOUBLE AS n FROM t JOIN hashed USING (gram) GROUP BY ALL HAVING sum(CASE WHEN h < 0 THEN -1 ELSE 1 END) <> 0)
SELECT id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)), 6) AS value FROM c""")
def _(spark, d):
    return moderate.hashed_features(inputs.texts(spark, d), analyzer="word", ngrams=(1, 1)).select("id", "bucket", F.round("value", 6).alias("value"))


on_documents("a9_sigmoid", lambda t: F.round(T.sigmoid((F.length(t) - 1500) / 100.0), 9), "round(CASE WHEN length(text) >= 1500 THEN 1 / (1 + exp(-((length(text) - 1500) / 100.0::DOUBLE))) ELSE exp((length(text) - 1500) / 100.0::DOUBLE) / (1 + exp((length(text) - 1500) / 100.0::DOUBLE)) END, 9)")


@query("a14_category_class", f"WITH {SAMPLES_SQL} SELECT id, CASE WHEN category IS NULL THEN 'missing' WHEN lower(trim(category)) = 'unknown' THEN 'unknown' ELSE 'other' END AS value FROM samples")
def _(spark, d):
    return inputs.samples(spark, d).select("id", T.category_class(F.col("category")).alias("value"))


@query("a15_parse_created_at", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS value FROM events")
def _(spark, d):
    raw = F.concat(F.lit(" "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.when(F.col("event_id") % 3 == 0, F.lit("Z")).otherwise(F.lit(" ")))
    return table(spark, d, "events").select("event_id", F.date_format(T.parse_created_at(raw), "yyyy-MM-dd HH:mm:ss").alias("value"))


VERDICTS = """verdicts AS (
  SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'no json here ' || source
    ELSE 'Sure: {"violation": ' || CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END || ', "category": "' || source || '", "confidence": 0.5} done' END AS content,
    source, toxic FROM documents JOIN labels USING (doc_id))"""


@query("a16_parse_verdict", f"""WITH {VERDICTS} SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN toxic = 1 END AS violation, CASE WHEN doc_id % 3 <> 0 THEN source END AS category,
  CASE WHEN doc_id % 3 <> 0 THEN 0.5::DOUBLE END AS confidence, doc_id % 3 = 0 AS failed FROM verdicts""")
def _(spark, d):
    v = _verdicts(spark, d).withColumn("v", T.parse_verdict(F.col("content")))
    return v.select("doc_id", "v.violation", "v.category", "v.confidence", F.col("v.parse_error").isNotNull().alias("failed"))


def _verdicts(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    body = F.concat(F.lit('Sure: {"violation": '), F.when(F.col("toxic") == 1, "true").otherwise("false"), F.lit(', "category": "'), "source", F.lit('", "confidence": 0.5} done'))
    return rows.withColumn("content", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("no json here "), "source")).otherwise(body))


@query("a17_content_text", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN coalesce(text, '') ELSE coalesce(text, '') || chr(10) || role END AS value FROM conversations")
def _(spark, d):
    c = table(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    parts = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text")), F.struct(F.lit("image").alias("type"), F.lit("x").alias("text")), F.struct(F.lit("text").alias("type"), F.col("role").alias("text"))))
    one = F.expr("substring(to_json(array(text)), 2, length(to_json(array(text))) - 2)")
    return c.select("conv_id", "turn", T.content_text(F.parse_json(F.when(F.col("turn") % 2 == 0, one).otherwise(parts))).alias("value"))


# B. sources and sinks


@query("b1_read_samples", f"WITH {SAMPLES_SQL} SELECT profile, id, label, category, text_hash FROM samples")
def _(spark, d):
    from modq.sources import tables

    path = fresh_path(spark, "samples")
    tables.write_samples(inputs.samples(spark, d), path)
    return tables.read_samples(spark, path).select("profile", "id", "label", "category", "text_hash")


@query("b2_append_samples", f"WITH {SAMPLES_SQL} SELECT profile, (SELECT max(id) FROM samples s WHERE s.profile = t.profile) + row_number() OVER (PARTITION BY profile) AS id FROM samples t")
def _(spark, d):
    s = inputs.samples(spark, d)
    return store.append_samples(s.select("profile", "text", "label", "category"), s).select("profile", "id")


@query("b1_read_json", f"WITH {SAMPLES_SQL} SELECT profile, id, text_hash, label, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM samples WHERE id % 11 > 1")
def _(spark, d):
    from modq.sources import tables

    read = tables.read_samples(spark, _export(spark, d), kind="json")
    return read.select("profile", "id", F.coalesce("text_hash", F.md5("text")).alias("text_hash"), "label", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


def _export(spark, d):
    """Samples as JSON lines: of each eleven ids one line is cut off and one has no id; a quarter lacks its hash."""
    line = F.to_json(F.struct(F.when(F.col("id") % 11 != 1, F.col("id")).alias("id"), "text", "label", "category", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), F.when(F.col("id") % 4 != 0, F.col("text_hash")).alias("text_hash")))
    path = fresh_path(spark, "export")
    rows = inputs.samples(spark, d).select("profile", F.when(F.col("id") % 11 == 0, F.left(line, F.length(line) - 3)).otherwise(line).alias("value"))
    rows.write.partitionBy("profile").text(path)
    return path


@query("b3_read_keywords", "SELECT pos, trim(line) AS original, lower(trim(line)) AS normalized FROM (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS pos, CASE WHEN s_suppkey % 10 = 0 THEN '# ' || s_name WHEN s_suppkey % 7 = 0 THEN '  ' ELSE '  ' || s_name || ' ' END AS line FROM supplier) WHERE s_kept(line)".replace("s_kept(line)", "trim(line) <> '' AND NOT starts_with(trim(line), '#')"))
def _(spark, d):
    from modq.sources import tables

    name, key = F.col("s_name"), F.col("s_suppkey")
    line = F.when(key % 10 == 0, F.concat(F.lit("# "), name)).when(key % 7 == 0, F.lit("  ")).otherwise(F.concat(F.lit("  "), name, F.lit(" ")))
    path = fresh_path(spark, "keywords")
    table(spark, d, "supplier").select("s_suppkey", line.alias("line")).coalesce(1).sortWithinPartitions("s_suppkey").select("line").write.text(path)
    return tables.read_keywords(spark, path).select(F.col("pos").cast("long").alias("pos"), "original", "normalized")


@query("b4_read_requests", "SELECT conv_id::VARCHAR AS request_id, length(conv_id::VARCHAR || max(role)) % 3 <> 0 AND count(*) % 2 = 0 AS readable FROM conversations GROUP BY conv_id")
def _(spark, d):
    from modq.sources import tables

    whole = inputs.requests(spark, d, "openai_chat").join(table(spark, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("c")).agg(F.max("role").alias("role"), F.count("*").alias("n")), F.col("request_id") == F.col("c"))
    sound = (F.length(F.concat("request_id", "role")) % 3 != 0) & (F.col("n") % 2 == 0)
    broken = F.when(F.col("n") % 2 == 1, F.left("body", F.length("body") - 1)).otherwise(F.concat("body", F.lit("]")))  # cut off, or with too much
    path = fresh_path(spark, "requests")
    whole.select("request_id", "profile", "path", "headers", F.when(sound, F.col("body")).otherwise(broken).alias("body")).write.json(path)
    return tables.read_requests(spark, path).select("request_id", "readable")


# C. sample store

query("c1_sample_counts", f"WITH {SAMPLES_SQL} SELECT profile, count(*) AS total, count(*) FILTER (label = 0) AS label_0, count(*) FILTER (label <> 0) AS label_1, max(id) + 1 AS next_id FROM samples GROUP BY profile")(lambda s, d: store.sample_counts(inputs.samples(s, d)))
query("c2_latest_by_text", f"WITH {SAMPLES_SQL} SELECT profile, text_hash, max(id) AS id FROM samples GROUP BY profile, text_hash")(lambda s, d: store.latest_by_text(inputs.samples(s, d)).select("profile", "text_hash", "id"))


@query("c3_import_legacy", "SELECT doc_id - 9 AS id, coalesce(text, '') AS text, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1 END AS label, CASE WHEN doc_id % 6 = 0 THEN '1970-01-01 00:00:00' ELSE '2024-05-06 07:08:09' END AS created_at, md5(coalesce(text, '')) AS text_hash, false AS rejected FROM documents WHERE doc_id >= 9 UNION ALL SELECT doc_id - 9, text, NULL, NULL, NULL, true FROM documents WHERE doc_id < 9")
def _(spark, d):
    old = table(spark, d, "documents").select((F.col("doc_id") - 9).alias("id"), "text", F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 4).alias("label"), F.col("source").alias("category"), F.when(F.col("doc_id") % 6 != 0, "2024-05-06 07:08:09").alias("created_at"))
    good, bad = store.import_legacy(old, "p")
    good = good.select("id", "text", "label", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), "text_hash", F.lit(False).alias("rejected"))
    none = F.lit(None).cast("string")
    return good.unionByName(bad.select("id", "text", F.lit(None).cast("int").alias("label"), none.alias("created_at"), none.alias("text_hash"), F.lit(True).alias("rejected")))


RAW_SQL = f"""{SAMPLES_SQL}, x AS (SELECT *, id % 11 > 1 AS sound FROM samples),
fresh AS (SELECT profile, 'count' AS name, count(*) AS value FROM x GROUP BY profile UNION ALL SELECT profile, 'count:0', count(*) FILTER (sound AND label = 0) FROM x GROUP BY profile UNION ALL SELECT profile, 'count:1', count(*) FILTER (sound AND label <> 0) FROM x GROUP BY profile
  UNION ALL SELECT profile, 'next_id', coalesce(max(id) FILTER (sound), 0) + 1 FROM x GROUP BY profile UNION ALL SELECT profile, 'text_latest:' || text_hash, max(id) FROM x WHERE sound GROUP BY profile, text_hash),
stored AS (SELECT profile, name, value + CASE WHEN value % 10 = 3 THEN 1 ELSE 0 END AS value FROM fresh WHERE profile <> 'de' AND value % 13 <> 5 UNION ALL SELECT profile, 'text_latest:none', 7 FROM fresh WHERE name = 'count' UNION ALL SELECT 'gone', 'count', 5)"""


def _stored(spark, d):
    """(raw records, what is stored of them: some of it wrong, some missing, some of records that don't exist)."""
    from modq.operators import repair
    from modq.sources import tables

    raw = tables.raw_samples(spark, _export(spark, d))
    fresh = store.rebuild_meta(raw)
    off = fresh.where("profile <> 'de' and value % 13 <> 5").withColumn("value", F.col("value") + F.when(F.col("value") % 10 == 3, 1).otherwise(0))
    more = fresh.where("name = 'count'").select("profile", F.lit("text_latest:none").alias("name"), F.lit(7).cast("bigint").alias("value"))
    meta = repair.meta_table(spark, fresh_path(spark, "meta"))
    meta.append(off.unionByName(more).unionByName(spark.createDataFrame([("gone", "count", 5)], repair.META)))
    return raw, meta


@query("c4_meta_drift", f"WITH {RAW_SQL} SELECT profile, name, s.value AS stored, f.value AS rebuilt FROM stored s FULL JOIN fresh f USING (profile, name) WHERE s.value IS DISTINCT FROM f.value")
def _(spark, d):
    from modq.operators import repair

    raw, meta = _stored(spark, d)
    return repair.repair(meta, raw)[0]


@query("c4_repair", f"WITH {RAW_SQL} SELECT profile, name, value FROM fresh")
def _(spark, d):
    from modq.operators import repair

    raw, meta = _stored(spark, d)
    return meta.read(repair.repair(meta, raw, dry_run=False)[1])


@query("c5_lookup_by_text", f"WITH {SAMPLES_SQL}, n AS (SELECT profile, text, max(id) AS hit_id, arg_max(label, id) AS hit_label FROM samples GROUP BY ALL) SELECT d.doc_id AS id, n.hit_id, n.hit_label FROM documents d LEFT JOIN n ON d.lang = n.profile AND d.text = n.text")
def _(spark, d):
    return store.lookup_by_text(inputs.texts(spark, d), inputs.samples(spark, d)).select("id", "hit_id", "hit_label")


@query("c6_lookup_by_id", f"WITH {SAMPLES_SQL} SELECT profile, id, label FROM samples SEMI JOIN (SELECT lang AS profile, doc_id AS id FROM documents) USING (profile, id)")
def _(spark, d):
    return store.lookup_by_id(inputs.texts(spark, d).select("profile", "id"), inputs.samples(spark, d)).select("profile", "id", "label")


def _ids(rows):
    return rows.select("id", "label")


RANDOM = "ORDER BY md5('42:' || id), id"
EACH = f"r AS (SELECT *, row_number() OVER (PARTITION BY label {RANDOM}) AS k, row_number() OVER (PARTITION BY label ORDER BY id DESC) AS newest, count(*) OVER (PARTITION BY label) AS n FROM samples), m AS (SELECT min(n) AS least, max(n) AS most, count(DISTINCT label) AS labels FROM r)"
query("c7_latest_samples", f"WITH {SAMPLES_SQL} SELECT id, label FROM samples ORDER BY id DESC LIMIT 100")(lambda s, d: _ids(store.latest_samples(inputs.samples(s, d), 100)))
query("c8_random_samples", f"WITH {SAMPLES_SQL} SELECT id, label FROM samples {RANDOM} LIMIT 100")(lambda s, d: _ids(store.random_samples(inputs.samples(s, d), 100)))
query("c9_balanced_undersample", f"WITH {SAMPLES_SQL}, {EACH} SELECT id, label FROM r, m WHERE labels = 2 AND k <= least(least, 200)")(lambda s, d: _ids(store.balanced_undersample(inputs.samples(s, d), 400)))
query("c10_balanced_latest", f"WITH {SAMPLES_SQL}, {EACH} SELECT id, label FROM r WHERE newest <= 100")(lambda s, d: _ids(store.balanced_latest(inputs.samples(s, d), 200)))
query("c11_balanced_random", f"WITH {SAMPLES_SQL}, {EACH} SELECT id, label FROM r WHERE k <= 100")(lambda s, d: _ids(store.balanced_random(inputs.samples(s, d), 200)))
query("c12_balanced_oversample", f"""WITH {SAMPLES_SQL}, {EACH}, t AS (SELECT least(200, most) AS target, labels FROM m),
c AS (SELECT id, label, CASE WHEN n >= target THEN (k <= target)::INT ELSE target // n + (k <= target % n)::INT END AS copies FROM r, t WHERE labels = 2)
SELECT id, label FROM (SELECT id, label, unnest(range(copies)) FROM c)""")(lambda s, d: _ids(store.balanced_oversample(inputs.samples(s, d), 400)))
query("c13_retain_balanced", f"WITH {SAMPLES_SQL}, {EACH} SELECT id, label FROM r WHERE NOT (n <= 100 OR k <= 100) AND (SELECT count(*) FROM samples) > 200")(lambda s, d: _ids(store.retain_balanced(inputs.samples(s, d), 200)[1]))
query("c14_pick_sample", f"""WITH {SAMPLES_SQL}, f AS (SELECT min(id) AS id FROM samples WHERE label = 1 AND lower(trim(category)) = 'unknown' AND trim(text) <> '' GROUP BY trim(text))
SELECT id, (SELECT count(*) FROM f) AS matched_samples FROM f {RANDOM} LIMIT 1""")(lambda s, d: store.pick_sample(inputs.samples(s, d), 1, "unknown").select("id", "matched_samples"))
query("c15_sampler", f"WITH {SAMPLES_SQL}, {EACH} SELECT id, label FROM r WHERE newest <= 60")(lambda s, d: _ids(store.sampler("latest_full")(inputs.samples(s, d), 120)))

# D. chat requests and responses

TURNS = "turns AS (SELECT conv_id::VARCHAR AS request_id, turn, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq FROM conversations)"


# a body of claude_chat that says nothing of its own (no system) matches openai_chat first
TOLD = "(SELECT conv_id, coalesce(bool_or(role = 'system' AND coalesce(text, '') <> ''), false) AS told FROM conversations GROUP BY conv_id)"


@query("d1_detect_dialect", f"SELECT d || ':' || conv_id AS request_id, CASE WHEN d = 'claude_chat' AND NOT told THEN 'openai_chat' ELSE d END AS dialect FROM {TOLD}, (VALUES ('gemini_chat'), ('openai_chat'), ('claude_chat'), ('openai_responses')) AS t(d)")
def _(spark, d):
    return chat.detect_dialect(inputs.all_requests(spark, d).drop("dialect")).select("request_id", "dialect")


@query("d1b_hint_dialect", "SELECT d || ':' || conv_id AS request_id, d AS hint FROM (SELECT DISTINCT conv_id FROM conversations), (VALUES ('gemini_chat'), ('openai_chat'), ('claude_chat'), ('openai_responses')) AS t(d)")
def _(spark, d):
    return chat.hint_dialect(inputs.all_requests(spark, d).drop("dialect")).select("request_id", "hint")


@query("d2_dialect_mismatch", f"SELECT '[''openai_chat'']' AS expected, d AS detected, count(*) FILTER (d <> 'claude_chat' OR told) AS n FROM {TOLD}, (VALUES ('gemini_chat'), ('claude_chat'), ('openai_responses')) AS t(d) GROUP BY d HAVING count(*) FILTER (d <> 'claude_chat' OR told) > 0")
def _(spark, d):
    return chat.dialect_mismatch_report(inputs.all_requests(spark, d).drop("dialect"), ("openai_chat",))


for _name, _sql in {
    "openai_chat": f"WITH {TURNS} SELECT request_id, seq::INT AS msg_seq, 0 AS block_seq, role, 'text' AS kind, text FROM turns",
    "claude_chat": f"""WITH {TURNS}, s AS (SELECT request_id, string_agg(text, chr(10) ORDER BY turn) FILTER (text <> '') AS told FROM turns WHERE role = 'system' GROUP BY ALL),
o AS (SELECT t.request_id, row_number() OVER (PARTITION BY t.request_id ORDER BY turn) - 1 + CASE WHEN s.told IS NULL THEN 0 ELSE 1 END AS q, CASE WHEN role = 'assistant' THEN role ELSE 'user' END AS role, text FROM turns t LEFT JOIN s USING (request_id) WHERE role <> 'system')
SELECT request_id, 0 AS msg_seq, 0 AS block_seq, 'system' AS role, 'text' AS kind, told AS text FROM s WHERE told IS NOT NULL UNION ALL SELECT request_id, q::INT, 0, role, 'text', text FROM o""",
    "openai_responses": f"""WITH {TURNS}, s AS (SELECT request_id, trim(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (text <> '')) AS told FROM turns WHERE role = 'system' GROUP BY ALL),
o AS (SELECT t.request_id, row_number() OVER (PARTITION BY t.request_id ORDER BY turn) - 1 + CASE WHEN s.told IS NULL THEN 0 ELSE 1 END AS q, role, text FROM turns t LEFT JOIN s USING (request_id) WHERE role <> 'system')
SELECT request_id, 0 AS msg_seq, 0 AS block_seq, 'system' AS role, 'text' AS kind, told AS text FROM s WHERE told IS NOT NULL UNION ALL SELECT request_id, q::INT, 0, role, 'text', text FROM o""",
    "gemini_chat": f"""WITH {TURNS}, s AS (SELECT request_id, string_agg(text, chr(10) ORDER BY turn) FILTER (text <> '') AS told FROM turns WHERE role = 'system' GROUP BY ALL),
o AS (SELECT t.request_id, row_number() OVER (PARTITION BY t.request_id ORDER BY turn) - 1 + CASE WHEN s.told IS NULL THEN 0 ELSE 1 END AS q, CASE WHEN role = 'assistant' THEN role ELSE 'user' END AS role, text FROM turns t LEFT JOIN s USING (request_id) WHERE role <> 'system' AND text <> '')
SELECT request_id, 0 AS msg_seq, 0 AS block_seq, 'system' AS role, 'text' AS kind, told AS text FROM s WHERE told IS NOT NULL UNION ALL SELECT request_id, q::INT, 0, role, 'text', text FROM o""",
}.items():
    query(f"d3_blocks_{_name}", _sql)(lambda s, d, n=_name: chat.explode_blocks(inputs.requests(s, d, n)).select("request_id", "msg_seq", "block_seq", "role", "kind", "text"))


@query("d3b_explode_tools", "SELECT conv_id::VARCHAR AS request_id, 0 AS seq, 'find' AS name, max(role) AS description, '{\"type\":\"object\"}' AS input_schema FROM conversations GROUP BY conv_id")
def _(spark, d):
    body = F.concat(F.lit('{"messages":[],"tools":[{"type":"function","function":{"name":"find","description":"'), F.max("role"), F.lit('","parameters":{"type":"object"}}}]}'))
    rows = table(spark, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("request_id")).agg(body.alias("body")).withColumn("dialect", F.lit("openai_chat"))
    return chat.explode_tools(rows)


TOOLED = "SELECT conv_id::VARCHAR AS request_id, turn::INT AS msg_seq, 0 AS block_seq, CASE WHEN turn % 3 = 2 THEN 'tool' ELSE role END AS role, CASE WHEN turn % 3 = 2 THEN 'tool_result' WHEN turn % 3 = 1 THEN 'tool_call' ELSE 'text' END AS kind, coalesce(text, '') AS text FROM conversations"


@query("d3c_drop_tool_blocks", f"WITH b AS ({TOOLED}) SELECT request_id, msg_seq, block_seq, role, 'text' AS kind, CASE WHEN kind = 'text' THEN text ELSE '' END AS text FROM b WHERE role <> 'tool'")
def _(spark, d):
    third = F.col("msg_seq") % 3
    b = inputs.conversation_blocks(spark, d).withColumn("kind", F.when(third == 2, "tool_result").when(third == 1, "tool_call").otherwise("text")).withColumn("role", F.when(third == 2, "tool").otherwise(F.col("role")))
    return chat.drop_tool_blocks(b).select("request_id", "msg_seq", "block_seq", "role", "kind", "text")


SAID = f"WITH {TURNS} SELECT request_id, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (text <> ''), '') AS text FROM turns GROUP BY request_id"
query("d4a_moderation_text_blocks", SAID)(lambda s, d: chat.moderation_text_blocks(inputs.conversation_blocks(s, d)))
query("d4b_moderation_text_body", SAID)(lambda s, d: chat.moderation_text_body(inputs.requests(s, d, "openai_chat")).select("request_id", "text"))

# bodies that no exporter of this library wrote: parts, images, tool messages, text without content, cut-off JSON

ODD_SQL = """odd AS (SELECT conv_id::VARCHAR AS request_id, turn, conv_id % 7 = 3 AS broken, conv_id % 5 = 1 AS refused,
  list_filter(CASE turn % 4 WHEN 0 THEN [coalesce(text, '')] WHEN 1 THEN [coalesce(text, ''), 'more'] WHEN 2 THEN [] ELSE [coalesce(text, '')] END, lambda x: x <> '') AS pieces FROM conversations)"""


def _odd_requests(spark, d):
    c = table(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    quoted = F.expr("substring(to_json(array(text)), 2, length(to_json(array(text))) - 2)")
    role = F.concat(F.lit('{"role":"'), F.col("role"), F.lit('","'))
    message = (
        F.when(F.col("turn") % 4 == 0, F.concat(role, F.lit('content":'), quoted, F.lit("}")))
        .when(F.col("turn") % 4 == 1, F.concat(role, F.lit('content":[{"type":"text","text":'), quoted, F.lit('},{"type":"image_url","image_url":{"url":"https://example.org/x.png"}},{"type":"output_text","text":"more"},{"type":"audio","text":"unheard"}]}')))
        .when(F.col("turn") % 4 == 2, F.concat(F.lit('{"role":"tool","tool_call_id":"c","content":'), quoted, F.lit("}")))
        .otherwise(F.concat(role, F.lit('name":null,"text":'), quoted, F.lit("}")))
    )
    listed = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))).alias("ms"))
    tools = F.when(F.col("conv_id") % 5 == 1, F.lit(',"tools":[{"name":"find","input_schema":{"type":"object"}}]')).otherwise(F.lit(""))
    body = F.concat(F.lit('{"model":"m","messages":['), F.array_join(F.transform("ms", lambda x: x.m), ","), F.lit("]"), tools, F.lit("}"))
    body = F.when(F.col("conv_id") % 7 == 3, F.left(body, F.length(body) - 2)).otherwise(body)
    return listed.select(F.col("conv_id").cast("string").alias("request_id"), F.lit("p").alias("profile"), F.lit("/v1/chat/completions").alias("path"), F.create_map().cast("map<string,string>").alias("headers"), body.alias("body"))


@query("d4b_odd_bodies", f"WITH {ODD_SQL} SELECT request_id, CASE WHEN any_value(broken) THEN '' ELSE coalesce(string_agg(array_to_string(pieces, chr(10)), chr(10) ORDER BY turn) FILTER (len(pieces) > 0), '') END AS text FROM odd GROUP BY request_id")
def _(spark, d):
    return chat.moderation_text_body(_odd_requests(spark, d).withColumn("dialect", F.lit("openai_chat"))).select("request_id", F.coalesce("text", F.lit("")).alias("text"))


@query("d1_odd_bodies", f"WITH {ODD_SQL} SELECT request_id, NOT any_value(broken) AND NOT any_value(refused) AS openai FROM odd GROUP BY request_id")
def _(spark, d):
    found = chat.detect_dialect(_odd_requests(spark, d))
    return found.select("request_id", F.array_contains("dialects", "openai_chat").alias("openai"))


query("d5_normalize_responses", """SELECT d || ':' || conv_id || ':' || turn AS response_id, d AS dialect, coalesce(text, '') AS text, 'completed' AS status, 3::BIGINT AS input_tokens, 4::BIGINT AS output_tokens, 7::BIGINT AS total_tokens
FROM conversations, (VALUES ('gemini_chat'), ('openai_chat'), ('claude_chat'), ('openai_responses')) AS t(d) WHERE role = 'assistant'""")(lambda s, d: chat.normalize_responses(inputs.responses(s, d)).select("response_id", "dialect", "text", "status", "input_tokens", "output_tokens", "total_tokens"))
query("d6_empty_response_flags", """SELECT d AS dialect, count(*) FILTER (length(coalesce(text, '')) <= 2) AS n_empty, count(*) AS n FROM conversations, (VALUES ('gemini_chat'), ('openai_chat'), ('claude_chat'), ('openai_responses')) AS t(d) WHERE role = 'assistant' GROUP BY d""")(lambda s, d: chat.empty_response_flags(inputs.responses(s, d)).groupBy("dialect").agg(F.count_if("empty").alias("n_empty"), F.count("*").alias("n")))
query("d7_chat_export", """SELECT conv_id::VARCHAR AS request_id, '/v1/chat/completions' AS path, '{"model":"model","messages":[' || string_agg('{"role":' || to_json(role) || ',"content":' || to_json(coalesce(text, '')) || '}', ',' ORDER BY turn) || ']}' AS body FROM conversations GROUP BY conv_id""")(lambda s, d: inputs.requests(s, d, "openai_chat").select("request_id", "path", "body"))
query("d8_prompt_token_report", rf"""WITH x AS ({SAID}), e AS (SELECT CASE WHEN t = '' THEN NULL ELSE ceil(0.28::DOUBLE * (length(t) - s - c) + 1.4::DOUBLE * c + 0.15::DOUBLE * s + 4.0::DOUBLE)::BIGINT END AS tokens FROM (SELECT t, len(regexp_extract_all(t, '\s')) AS s, length(t) - length(replace(t, '語', '')) AS c FROM (SELECT regexp_replace(replace(text, 'e', '語'), '^\s+|\s+$', '', 'g') AS t FROM x)))
SELECT 'openai_chat' AS dialect, count(*) AS requests, sum(tokens)::BIGINT AS tokens, round(avg(tokens), 6) AS average FROM e""")(lambda s, d: chat.prompt_token_report(_cjk_requests(s, d)).select("dialect", "requests", "tokens", F.round("average", 6).alias("average")))


def _cjk_requests(spark, d):
    """Requests whose texts have a CJK character for every e."""
    blocks = inputs.conversation_blocks(spark, d).withColumn("text", F.translate("text", "e", "語"))
    rows = chat.chat_export(blocks, "openai_chat")
    return rows.withColumn("dialect", F.lit("openai_chat")).withColumn("headers", F.create_map().cast("map<string,string>")).withColumn("profile", F.lit("p"))


# E. stream logs


PIECES = """pieces AS (SELECT conv_id || ':' || turn AS stream_id, [substr(coalesce(text, ''), 400 * i + 1, 400) FOR i IN range(0, ((length(coalesce(text, '')) + 399) // 400)::BIGINT)] AS p FROM conversations WHERE role = 'assistant')"""


@query("e1_chunks_to_frames", f"""WITH {PIECES}, frames AS (SELECT stream_id, list_concat(['{{"choices":[{{"index":0,"delta":{{"content":' || to_json(x) || '}}}}]}}' FOR x IN p], ['{{"choices":[{{"index":0,"delta":{{}},"finish_reason":"stop"}}]}}', '[DONE]']) AS f FROM pieces)
SELECT stream_id, unnest(range(1, len(f) + 1)) AS nth, unnest(f) AS data FROM frames""")
def _(spark, d):
    frames = streams.chunks_to_frames(inputs.stream_chunks(spark, d))
    return frames.select("stream_id", F.row_number().over(Window.partitionBy("stream_id").orderBy("frame_seq")).cast("long").alias("nth"), "data")


@query("e2_frames_to_events", f"""WITH {PIECES}, e AS (SELECT stream_id, list_concat([{{'kind': 'text', 'text': x, 'finish': NULL::VARCHAR}} FOR x IN p], [{{'kind': 'final', 'text': NULL, 'finish': 'stop'}}, {{'kind': 'done', 'text': NULL, 'finish': NULL}}]) AS e FROM pieces)
SELECT stream_id, nth, x.kind AS kind, x.text AS text, x.finish AS finish_reason FROM (SELECT stream_id, unnest(range(1, len(e) + 1)) AS nth, unnest(e) AS x FROM e)""")
def _(spark, d):
    e = streams.frames_to_events(streams.chunks_to_frames(inputs.stream_chunks(spark, d)))
    nth = F.row_number().over(Window.partitionBy("stream_id").orderBy("frame_seq", "sub")).cast("long")
    return e.select("stream_id", nth.alias("nth"), "kind", "text", "finish_reason")


@query("e3_reassemble_streams", "SELECT conv_id || ':' || turn AS stream_id, coalesce(text, '') AS text, 'stop' AS finish_reason, true AS done FROM conversations WHERE role = 'assistant'")
def _(spark, d):
    e = streams.frames_to_events(streams.chunks_to_frames(inputs.stream_chunks(spark, d)))
    return streams.reassemble_streams(e).select("stream_id", "text", "finish_reason", "done")


CHUNKED = r"""said AS (SELECT conv_id || ':' || turn AS stream_id, coalesce(text, '') AS text FROM conversations WHERE role = 'assistant'),
pieces AS (SELECT stream_id, text, [substr(text, 400 * i + 1, 400) FOR i IN range(0, ((length(text) + 399) // 400)::BIGINT)] AS p FROM said),
bodies AS (SELECT stream_id, text, array_to_string(['data: {"choices":[{"index":0,"delta":{"content":' || to_json(x) || '}}]}' || chr(10) || chr(10) FOR x IN p], '') || 'data: {"choices":[{"index":0,"delta":{},"finish_reason":"stop"}]}' || chr(10) || chr(10) || 'data: [DONE]' || chr(10) || chr(10) AS body FROM pieces),
chunks AS (SELECT stream_id, text, i AS seq, sum(octet_length(encode(substr(body, 1000 * i + 1, 1000)))) OVER (PARTITION BY stream_id ORDER BY i) AS upto
  FROM (SELECT stream_id, text, body, unnest(range(0, ((length(body) + 999) // 1000)::BIGINT)) AS i FROM bodies))"""


@query("e4_stream_health", f"""WITH {CHUNKED},
heard AS (SELECT stream_id, (length('data: {{"choices":[{{"index":0,"delta":{{"content":' || to_json(p[1]) || '}}}}]}}') + 2 - 1) // 1000 AS heard_at FROM pieces WHERE length(text) > 2)
SELECT stream_id, max(upto)::BIGINT AS bytes, coalesce(least(any_value(heard_at), min(seq) FILTER (upto > 1048)), -1)::BIGINT AS passed_at, length(any_value(text)) > 2 OR max(upto) > 1048 AS passes,
  CASE WHEN length(any_value(text)) > 2 OR max(upto) > 1048 THEN NULL ELSE 'stream content is too short' END AS message FROM chunks LEFT JOIN heard USING (stream_id) GROUP BY stream_id""")
def _(spark, d):
    return streams.stream_health(inputs.stream_chunks(spark, d)).withColumn("passed_at", F.coalesce("passed_at", F.lit(-1)))


# G1 comes before F, which scores with its model

MODEL_SQL = rf"""{SAMPLES_SQL}, {EACH}, chosen AS MATERIALIZED (SELECT id, text, label FROM r, m WHERE labels = 2 AND k <= least(least, {TRAIN // 2})),
tokens AS (SELECT id, label, unnest(regexp_split_to_array(lower(text), '\s+')) AS term FROM chosen),
stats AS (SELECT term, count(*) FILTER (label = 0) AS pass_hits, count(*) FILTER (label <> 0) AS violation_hits, count(DISTINCT id) AS df FROM tokens WHERE term <> '' GROUP BY term),
model AS MATERIALIZED (SELECT *, ln(((SELECT count(*) FROM chosen) + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) + 1.0 AS idf, ln((violation_hits + 1.0::DOUBLE) / (pass_hits + 1.0::DOUBLE)) AS weight FROM stats ORDER BY abs(violation_hits - pass_hits) DESC, df DESC, term LIMIT {MAX_TERMS}),
intercept AS (SELECT ln((count(*) FILTER (label <> 0) + 1.0::DOUBLE) / (count(*) FILTER (label = 0) + 1.0::DOUBLE)) AS b FROM chosen)"""


def _scores_sql(idf: str, texts: str = "documents") -> str:
    return rf"""{MODEL_SQL}, words AS (SELECT doc_id AS id, unnest(regexp_split_to_array(lower(text), '\s+')) AS term FROM {texts}),
sums AS (SELECT id, sum(weight * {idf}) AS s FROM words JOIN model USING (term) GROUP BY id),
scored AS (SELECT doc_id AS id, lang AS profile, text, b + coalesce(s, 0) AS z FROM {texts} LEFT JOIN sums ON doc_id = id, intercept),
p AS (SELECT id, profile, text, CASE WHEN z >= 0 THEN 1 / (1 + exp(-z)) ELSE exp(z) / (1 + exp(z)) END AS p FROM scored)"""


def _model(spark, d):
    chosen = written(store.balanced_undersample(inputs.samples(spark, d), TRAIN), "chosen")
    terms, intercept = train.train_terms(chosen, MAX_TERMS)
    return written(terms, "terms"), intercept


@query("g1_train_terms", f"WITH {MODEL_SQL} SELECT term, pass_hits, violation_hits, df, round(idf, 6) AS idf, round(weight, 6) AS weight FROM model")
def _(spark, d):
    return _model(spark, d)[0].select("term", "pass_hits", "violation_hits", "df", F.round("idf", 6).alias("idf"), F.round("weight", 6).alias("weight"))


@query("g2_train_hashed")
def _(spark, d):
    weights, intercept = train.train_hashed(store.balanced_undersample(inputs.samples(spark, d), TRAIN))
    return weights.select("bucket", "weight", F.lit(intercept).alias("intercept"))


@query("g3_train")
def _(spark, d):
    version, run = train.train(inputs.samples(spark, d), fresh_path(spark, "models"), max_samples=TRAIN, max_features=MAX_TERMS)
    rows, meta = train.read_model(spark, version)
    return rows.select("term", "weight", F.lit(meta["intercept"]).alias("intercept"))


@query("b6_write_report", f"WITH {SAMPLES_SQL} SELECT profile, count(*) AS total, count(*) FILTER (label = 0) AS label_0, count(*) FILTER (label <> 0) AS label_1, max(id) + 1 AS next_id FROM samples GROUP BY profile")
def _(spark, d):
    path = fresh_path(spark, "report")
    report = store.sample_counts(inputs.samples(spark, d))
    write_report(report, path)
    return spark.read.schema(report.schema).json(path)


@query("b5_write_read_model", "SELECT i AS bucket, ((i % 7) - 3)::FLOAT AS weight, 0.5::DOUBLE AS intercept, 4096 AS n_features, 2 AS least, 3 AS most, n AS n_rows FROM (SELECT DISTINCT (doc_id % 4096)::INT AS i, count(DISTINCT doc_id % 4096) OVER () AS n FROM documents)")
def _(spark, d):
    rows = table(spark, d, "documents").select((F.col("doc_id") % 4096).cast("int").alias("bucket")).distinct().withColumn("weight", (F.col("bucket") % 7 - 3).cast("float"))
    path = fresh_path(spark, "models")
    train.write_model(rows, {"model_type": "hashed", "intercept": 0.5, "features": {"n_features": 4096, "ngrams": (2, 3)}}, path)
    found, meta = train.read_model(spark, train.current_version(spark, path))
    least, most = meta["features"]["ngrams"]
    return found.select("bucket", "weight", F.lit(meta["intercept"]).alias("intercept"), F.lit(meta["n_features"]).alias("n_features"), F.lit(least).alias("least"), F.lit(most).alias("most"), F.lit(meta["n_rows"]).alias("n_rows"))


@query("g4_training_readiness", f"""WITH {SAMPLES_SQL}, c AS (SELECT profile, count(*) AS n, min(id) % 3 AS kind FROM samples GROUP BY profile)
SELECT profile, CASE WHEN n < 60 THEN 'insufficient_samples' WHEN kind = 0 THEN 'model_missing' WHEN kind = 1 THEN 'retrain_interval_elapsed' ELSE 'retrain_interval_not_elapsed' END AS reason FROM c""")
def _(spark, d):
    s = inputs.samples(spark, d)
    kinds = s.groupBy("profile").agg((F.min("id") % 3).alias("kind"))
    profiles = kinds.select("profile", F.lit(60).alias("min_samples"), F.lit(60).alias("retrain_interval_minutes"))
    models = kinds.where("kind > 0").select("profile", F.when(F.col("kind") == 1, 0).otherwise(9000).cast("long").alias("trained_at"))
    runs = kinds.select("profile", F.lit("completed").alias("status"), F.lit(100).cast("long").alias("timestamp"))
    return train.training_readiness(profiles, s, models, runs, now=10_000).select("profile", "reason")


# F. moderation

query("f1_keyword_block", f"""WITH {KEYWORDS_SQL}, h AS (SELECT doc_id, arg_min(original, pos) AS keyword FROM documents JOIN keywords ON contains(translate(text, '{T.UPPER}', '{T.LOWER}'), normalized) GROUP BY doc_id)
SELECT d.doc_id AS id, keyword, '[BASIC_MODERATION_BLOCKED] Matched keyword: ' || keyword AS keyword_reason FROM documents d LEFT JOIN h USING (doc_id)""")(lambda s, d: moderate.keyword_block(inputs.texts(s, d), inputs.keywords(s)).select("id", "keyword", "keyword_reason"))


def _scored(spark, d, use_idf=True):
    terms, intercept = _model(spark, d)
    return moderate.score_terms(inputs.texts(spark, d), terms, intercept, use_idf=use_idf)


query("f2_score_terms", f"WITH {_scores_sql('idf')} SELECT id, round(p, 6) AS p FROM p")(lambda s, d: _scored(s, d).select("id", F.round("p", 6).alias("p")))
query("f3_score_tokens", f"WITH {_scores_sql('1.0')} SELECT id, round(p, 6) AS p FROM p")(lambda s, d: _scored(s, d, False).select("id", F.round("p", 6).alias("p")))


@query("f4_score_hashed")
def _(spark, d):
    weights, intercept = train.train_hashed(store.balanced_undersample(inputs.samples(spark, d), TRAIN))
    return moderate.score_hashed(inputs.texts(spark, d), weights, intercept).select("id", F.round("p", 6).alias("p"))


#: Scores under fixed weights of all buckets, so that SQL can follow the features of every text: 2- to 4-grams, 2**20 buckets, length 1.
@query("f4_score_hashed_fixed", rf"""WITH plain AS (SELECT doc_id AS id, string_split(regexp_replace(lower(translate(text, chr(13) || chr(10), '  ')), {SPACE}, ' ', 'g'), '') AS c FROM documents),
counts AS MATERIALIZED (SELECT id, gram, count(*) AS n FROM (
  SELECT id, unnest(list_concat([c[i] || c[i + 1] FOR i IN range(1, len(c))], [c[i] || c[i + 1] || c[i + 2] FOR i IN range(1, len(c) - 1)], [c[i] || c[i + 1] || c[i + 2] || c[i + 3] FOR i IN range(1, len(c) - 2)])) AS gram FROM plain) GROUP BY ALL),
g AS (SELECT DISTINCT gram FROM counts), {MURMUR_SQL},
features AS (SELECT id, abs(h) % 1048576 AS bucket, sum(CASE WHEN h < 0 THEN -n ELSE n END)::DOUBLE AS value FROM counts JOIN hashed USING (gram) GROUP BY ALL),
sums AS (SELECT id, sum(value * (bucket % 13 - 6)) / sqrt(sum(value * value)) AS s FROM features GROUP BY id)
SELECT doc_id AS id, round(1 / (1 + exp(-(0.25::DOUBLE + CASE WHEN isfinite(s) THEN s ELSE 0 END))), 6) AS p FROM documents LEFT JOIN sums ON id = doc_id""")
def _(spark, d):
    weights = spark.range(1 << 20).select(F.col("id").cast("int").alias("bucket"), (F.col("id") % 13 - 6).cast("float").alias("weight"))
    return moderate.score_hashed(inputs.texts(spark, d), weights, 0.25).select("id", F.round("p", 6).alias("p"))


BANDS = "CASE WHEN p < 0.2 THEN 'allow' WHEN p > 0.8 THEN 'block' ELSE 'uncertain' END"
query("f5_decide", f"WITH {_scores_sql('idf')} SELECT id, {BANDS} AS decision FROM p")(lambda s, d: moderate.decide(_scored(s, d)).select("id", "decision"))
query("f6_force_review", "SELECT doc_id AS id, ('0x' || left(md5('42:' || doc_id), 13))::BIGINT / pow(2, 52) < 0.25 AS forced FROM documents")(lambda s, d: moderate.force_review(inputs.texts(s, d), 0.25).select("id", "forced"))
query("f7_capacity_fallback", f"""WITH {_scores_sql('idf')}, q AS (SELECT id, p, row_number() OVER (ORDER BY round(abs(p - 0.5), 9), id) AS k FROM (SELECT id, round(p, 9) AS p FROM p))
SELECT id, CASE WHEN k <= 50 THEN 'review' ELSE 'local_fallback' END AS route, CASE WHEN k > 50 THEN p >= 0.5 END AS violation FROM q""")(lambda s, d: moderate.capacity_fallback(_scored(s, d).select("id", F.round("p", 9).alias("p")), 50).select("id", "route", "violation"))

#: Characters of a text that the flow looks at after the keywords: its default.
MOST_TEXT = 4000
CUT_TEXTS = f"(SELECT doc_id, lang, CASE WHEN length(text) > {MOST_TEXT} THEN left(text, {2 * MOST_TEXT // 3}) || chr(10) || '...[中间省略]...' || chr(10) || right(text, {MOST_TEXT - 2 * MOST_TEXT // 3}) ELSE text END AS text FROM documents)"
FLOW_SQL = f"""{_scores_sql('idf', CUT_TEXTS)}, {KEYWORDS_SQL},
hit AS (SELECT doc_id AS id, arg_min(original, pos) AS keyword FROM documents JOIN keywords ON contains(translate(text, '{T.UPPER}', '{T.LOWER}'), normalized) GROUP BY doc_id),
history AS (SELECT profile, text, max(id) AS hit_id, arg_max(label, id) AS hit_label, arg_max_null(category, id) AS hit_category FROM samples GROUP BY ALL),
flow AS (SELECT p.id, p.profile, p.text, p.p, p.forced, hit_category, CASE WHEN keyword IS NOT NULL THEN 'block' WHEN forced OR p.p BETWEEN 0.2 AND 0.8 THEN CASE WHEN hit_id IS NULL THEN 'review' WHEN hit_label = 0 THEN 'allow' ELSE 'block' END WHEN p.p < 0.2 THEN 'allow' ELSE 'block' END AS decision,
  CASE WHEN keyword IS NOT NULL THEN 'keyword' WHEN forced OR p.p BETWEEN 0.2 AND 0.8 THEN CASE WHEN hit_id IS NULL THEN 'review' ELSE 'history' END ELSE 'local' END AS source
  FROM (SELECT *, ('0x' || left(md5('42:' || md5(text)), 13))::BIGINT / pow(2, 52) < 0.3 AS forced FROM p) p LEFT JOIN hit USING (id) LEFT JOIN history h ON h.profile = p.profile AND h.text = p.text)"""


def _decisions(spark, d):
    terms, intercept = _model(spark, d)
    return moderate.moderate(inputs.texts(spark, d), inputs.keywords(spark), lambda t: moderate.score_terms(t, terms, intercept), inputs.samples(spark, d), max_text=MOST_TEXT, review_rate=0.3)


def _messages(spark, d):
    """The messages of all decisions; the confidence, which formatting rounds, as a number of its own."""
    told = moderate.block_message(_decisions(spark, d))
    shown = F.regexp_extract("message", r" \(confidence: ([0-9.]+)\)$", 1)
    near = F.abs(F.try_to_number(shown, F.lit("9.999")).cast("double") - F.col("p")) < 0.000501
    confidence = F.when(near, F.round("p", 6))
    return told.select("id", F.regexp_replace("message", r" \(confidence: [0-9.]+\)$", "").alias("message"), confidence.alias("confidence"))


query("f8_moderate", f"WITH {FLOW_SQL} SELECT id, profile, decision, source FROM flow")(lambda s, d: _decisions(s, d).select("id", "profile", "decision", "source"))
PROMPT = "replace('Judge this text: {{text}}', '{{text}}', replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;'))"
query("f9_review_queue", f"WITH {FLOW_SQL} SELECT profile, md5(text) AS text_hash, min({PROMPT}) AS prompt FROM flow WHERE decision = 'review' GROUP BY profile, text")(lambda s, d: moderate.review_queue(_decisions(s, d), inputs.texts(s, d), TEMPLATE, MOST_TEXT).select("profile", "text_hash", "prompt"))


@query("f10_apply_verdicts", f"WITH {VERDICTS} SELECT d.lang AS profile, md5(d.text) AS text_hash, v.toxic::INT AS label, v.source AS category FROM verdicts v JOIN documents d USING (doc_id) WHERE doc_id % 3 <> 0")
def _(spark, d):
    v = _verdicts(spark, d).select(F.col("lang").alias("profile"), F.concat_ws(":", "doc_id", F.md5("text")).alias("text_hash"), "text", "content")
    good, _ = moderate.apply_verdicts(v.select("profile", "text_hash", "text"), v.select("profile", "text_hash", "content"))
    return good.select("profile", F.md5("text").alias("text_hash"), "label", "category")


query("f11_block_message", f"""WITH {FLOW_SQL} SELECT id, CASE WHEN decision = 'block' THEN 'Smart moderation blocked by ' || source || CASE WHEN source = 'history' AND hit_category <> '' THEN ' (category: ' || hit_category || ')' ELSE '' END END AS message, CASE WHEN decision = 'block' AND source <> 'keyword' AND NOT forced THEN round(p, 6) END AS confidence FROM flow""")(_messages)
query("f12_decision_report", f"WITH {FLOW_SQL} SELECT profile, source, decision, count(*) AS n FROM flow GROUP BY ALL")(lambda s, d: moderate.decision_report(_decisions(s, d)))

# many profiles in one plan: settings, keywords, samples and models of each

#: Fixed settings of three languages' profiles; the others have defaults.
PROFILES = [("en", 0.25, 0.75, 4000, 0.3, 42, "EN_BLOCKED"), ("fr", 0.3, 0.7, 1000, 0.1, 7, "FR_BLOCKED"), ("de", 0.1, 0.9, 2000, 0.0, 1, None)]
PROFILE_KEYWORDS = [("en", 2, "wheheat", "wheheat"), ("en", 1, "Loser", "loser"), ("fr", 1, "Oui", "oui"), ("de", 1, "thhati er", "thhati er")]
FASTTEXT = ("fr",)


def _profiles(spark):
    return spark.createDataFrame(PROFILES, "profile string, low double, high double, max_text int, review_rate double, seed long, error_code string")


def _limits(spark, d):
    """Every profile's training settings: strategies by language."""
    names = inputs.samples(spark, d).select("profile").distinct()
    strategy = F.when(F.col("profile") == "de", "random_duplicate").when(F.col("profile") == "es", "random_full").when(F.col("profile") == "fr", "latest_full").otherwise("balanced_undersample")
    return names.select("profile", F.lit(TRAIN).alias("most"), F.lit(200).alias("few"), F.lit(MAX_TERMS).alias("max_features"), strategy.alias("strategy"))


def _profile_models(spark, d):
    limits = _limits(spark, d)
    chosen = written(grouped.balanced_samples(inputs.samples(spark, d), limits.withColumn("strategy", F.lit("balanced_undersample"))), "chosen")
    terms, models = grouped.train_terms_profiles(chosen, limits)
    kind = F.when(F.col("profile").isin(*FASTTEXT), "fasttext").otherwise("bow")
    none = spark.createDataFrame([], "profile string, bucket int, weight float")
    return profiles.Catalog(written(models.withColumn("model_type", kind), "models"), written(terms, "terms"), none)


BY_PROFILE = f"""r AS (SELECT *, row_number() OVER (PARTITION BY profile, label {RANDOM}) AS k, row_number() OVER (PARTITION BY profile, label ORDER BY id DESC) AS newest, count(*) OVER (PARTITION BY profile, label) AS n FROM samples),
m AS (SELECT profile, min(n) AS least, max(n) AS most, count(DISTINCT label) AS labels FROM r GROUP BY profile)"""
PROFILE_MODEL_SQL = rf"""{SAMPLES_SQL}, {BY_PROFILE}, chosen AS MATERIALIZED (SELECT profile, id, text, label FROM r JOIN m USING (profile) WHERE labels = 2 AND k <= least(least, {TRAIN // 2})),
sizes AS (SELECT profile, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label <> 0) AS n1 FROM chosen GROUP BY profile),
tokens AS (SELECT profile, id, label, unnest(regexp_split_to_array(lower(text), '\s+')) AS term FROM chosen),
stats AS (SELECT profile, term, count(*) FILTER (label = 0) AS pass_hits, count(*) FILTER (label <> 0) AS violation_hits, count(DISTINCT id) AS df FROM tokens WHERE term <> '' GROUP BY ALL),
top AS (SELECT * FROM stats QUALIFY row_number() OVER (PARTITION BY profile ORDER BY abs(violation_hits - pass_hits) DESC, df DESC, encode(term)) <= {MAX_TERMS}),
model AS MATERIALIZED (SELECT *, ln((n0 + n1 + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) + 1.0 AS idf, ln((violation_hits + 1.0::DOUBLE) / (pass_hits + 1.0::DOUBLE)) AS weight FROM top JOIN sizes USING (profile)),
biases AS (SELECT profile, ln((n1 + 1.0::DOUBLE) / (n0 + 1.0::DOUBLE)) AS b FROM sizes)"""


@query("g1_train_profiles", f"WITH {PROFILE_MODEL_SQL} SELECT profile, term, pass_hits, violation_hits, df, round(idf, 6) AS idf, round(weight, 6) AS weight, round(b, 6) AS intercept FROM model JOIN biases USING (profile)")
def _(spark, d):
    catalog = _profile_models(spark, d)
    return catalog.terms.join(catalog.models.select("profile", F.round("intercept", 6).alias("intercept")), "profile").select("profile", "term", "pass_hits", "violation_hits", "df", F.round("idf", 6).alias("idf"), F.round("weight", 6).alias("weight"), "intercept")


@query("g2_train_hashed_profiles")
def _(spark, d):
    buckets, models = grouped.train_hashed_profiles(grouped.balanced_samples(inputs.samples(spark, d), _limits(spark, d).withColumn("strategy", F.lit("balanced_undersample"))))
    return buckets.join(models.select("profile", "intercept"), "profile")


@query("c15_samples_by_profile", f"""WITH {SAMPLES_SQL}, {BY_PROFILE}, c AS (SELECT r.profile, id, label, CASE profile
  WHEN 'fr' THEN (newest <= 100)::BIGINT WHEN 'es' THEN (k <= 100)::BIGINT
  WHEN 'de' THEN CASE WHEN labels < 2 THEN 0 WHEN n >= least(100, most) THEN (k <= least(100, most))::BIGINT ELSE least(100, most) // n + (k <= least(100, most) % n)::BIGINT END
  ELSE (labels = 2 AND k <= least(least, 100))::BIGINT END AS copies FROM r JOIN m USING (profile))
SELECT profile, id, label FROM (SELECT profile, id, label, unnest(range(copies)) FROM c)""")
def _(spark, d):
    limits = _limits(spark, d).select("profile", F.col("few").alias("most"), "strategy")
    return grouped.balanced_samples(inputs.samples(spark, d), limits).select("profile", "id", "label")


@query("c13_retain_by_profile", f"WITH {SAMPLES_SQL}, {BY_PROFILE}, t AS (SELECT profile, count(*) AS total FROM samples GROUP BY profile) SELECT profile, id, label FROM r JOIN t USING (profile) WHERE total > 60 AND k > 30")
def _(spark, d):
    limits = _limits(spark, d).select("profile", F.lit(60).alias("most"))
    return grouped.retain_profiles(inputs.samples(spark, d), limits)[1].select("profile", "id", "label")


CUT = "CASE WHEN length(text) > most THEN left(text, 2 * most // 3) || chr(10) || '...[中间省略]...' || chr(10) || right(text, most - 2 * most // 3) ELSE text END"
_values = lambda rows: ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
PROFILE_FLOW_SQL = rf"""{PROFILE_MODEL_SQL}, own(profile, low, high, most, rate, seed, code) AS (VALUES {_values(PROFILES)}), words(profile, pos, original, normalized) AS (VALUES {_values(PROFILE_KEYWORDS)}),
told AS (SELECT doc_id AS id, lang AS profile, text AS whole, coalesce(low, 0.2)::DOUBLE AS low, coalesce(high, 0.8)::DOUBLE AS high, coalesce(most, 4000) AS most, coalesce(rate, 0.3)::DOUBLE AS rate, coalesce(seed, 42) AS seed, coalesce(code, 'BASIC_MODERATION_BLOCKED') AS code FROM documents LEFT JOIN own ON profile = lang),
hit AS (SELECT id, arg_min(original, pos) AS keyword FROM told t JOIN words w ON w.profile = t.profile AND contains(translate(whole, '{T.UPPER}', '{T.LOWER}'), normalized) GROUP BY id),
cut AS (SELECT * EXCLUDE (text), {CUT} AS text FROM (SELECT *, whole AS text FROM told)),
seen AS (SELECT id, profile, unnest(regexp_split_to_array(lower(text), '\s+')) AS term FROM cut),
sums AS (SELECT id, sum(weight * CASE WHEN profile IN ({', '.join(f"'{x}'" for x in FASTTEXT)}) THEN 1.0::DOUBLE ELSE idf END) AS s FROM seen JOIN model USING (profile, term) GROUP BY id),
scored AS (SELECT cut.*, b + coalesce(s, 0) AS z FROM cut LEFT JOIN sums USING (id) LEFT JOIN biases USING (profile)),
p AS (SELECT *, CASE WHEN z >= 0 THEN 1 / (1 + exp(-z)) WHEN z < 0 THEN exp(z) / (1 + exp(z)) END AS p, CASE WHEN rate <= 0 THEN false ELSE ('0x' || left(md5(seed || ':' || md5(text)), 13))::BIGINT / pow(2, 52) < rate END AS forced FROM scored),
history AS (SELECT profile, text, max(id) AS hit_id, arg_max(label, id) AS hit_label FROM samples GROUP BY ALL),
flow AS (SELECT p.*, keyword, code, CASE WHEN keyword IS NOT NULL THEN 'keyword' WHEN NOT forced AND p IS NOT NULL AND (p < low OR p > high) THEN 'local' WHEN hit_id IS NOT NULL THEN 'history' ELSE 'review' END AS source, hit_label
  FROM p LEFT JOIN hit USING (id) LEFT JOIN history h ON h.profile = p.profile AND h.text = p.text)"""


def _profile_words(spark):
    return spark.createDataFrame(PROFILE_KEYWORDS, "profile string, pos int, original string, normalized string")


@query("f8_moderate_profiles", f"""WITH {PROFILE_FLOW_SQL} SELECT id, profile, source, CASE source WHEN 'keyword' THEN 'block' WHEN 'local' THEN CASE WHEN p < low THEN 'allow' ELSE 'block' END WHEN 'history' THEN CASE WHEN hit_label = 0 THEN 'allow' ELSE 'block' END ELSE 'review' END AS decision,
  CASE WHEN keyword IS NOT NULL THEN '[' || code || '] Matched keyword: ' || keyword END AS told, CASE WHEN keyword IS NULL AND NOT forced THEN round(p, 6) END AS p FROM flow""")
def _(spark, d):
    decided = profiles.moderate_profiles(inputs.texts(spark, d), _profiles(spark), _profile_words(spark), _profile_models(spark, d), inputs.samples(spark, d))
    return decided.select("id", "profile", "source", "decision", F.when(F.col("source") == "keyword", F.col("reason")).alias("told"), F.round("p", 6).alias("p"))


@query("f7_capacity_by_profile", rf"""WITH {PROFILE_MODEL_SQL}, own(profile, low, high, most, rate, seed, code) AS (VALUES {_values(PROFILES)}), seen AS (SELECT doc_id AS id, lang AS profile, unnest(regexp_split_to_array(lower(text), '\s+')) AS term FROM documents),
sums AS (SELECT id, sum(weight * CASE WHEN profile IN ({', '.join(f"'{x}'" for x in FASTTEXT)}) THEN 1.0::DOUBLE ELSE idf END) AS s FROM seen JOIN model USING (profile, term) GROUP BY id),
scored AS (SELECT doc_id AS id, lang AS profile, b + coalesce(s, 0) AS z FROM documents LEFT JOIN sums ON id = doc_id JOIN biases ON profile = lang),
p AS (SELECT id, scored.profile, round(CASE WHEN z >= 0 THEN 1 / (1 + exp(-z)) ELSE exp(z) / (1 + exp(z)) END, 6) AS p, (coalesce(low, 0.2)::DOUBLE + coalesce(high, 0.8)::DOUBLE) / 2 AS middle FROM scored LEFT JOIN own USING (profile))
SELECT id, profile, CASE WHEN row_number() OVER w <= 20 THEN 'review' ELSE 'local_fallback' END AS route, CASE WHEN row_number() OVER w > 20 THEN p >= middle END AS violation FROM p WINDOW w AS (PARTITION BY profile ORDER BY abs(p - middle), id)""")
def _(spark, d):
    texts = inputs.texts(spark, d)
    scored = written(profiles.score_profiles(texts, _profile_models(spark, d)).where("p is not null").select("id", F.round("p", 6).alias("p")), "scores")  # read twice
    uncertain = texts.select("id", "profile").join(scored, "id")
    room = uncertain.select("profile").distinct().join(_profiles(spark), "profile", "left").withColumn("capacity", F.lit(20))
    return profiles.capacity_fallback_profiles(uncertain, room).select("id", "profile", "route", "violation")


# H. evaluation and statistics

LABELLED_SQL = f"WITH {_scores_sql('idf')}, x AS (SELECT label, round(p, 6) AS p FROM samples JOIN (SELECT id + 1 AS id, p FROM p) USING (id))"


def _labelled(spark, d):
    return inputs.samples(spark, d).select("id", "label").join(_scored(spark, d).select((F.col("id") + 1).alias("id"), F.round("p", 6).alias("p")), "id")


def _metrics_sql(thresholds: str) -> str:
    return f"""{LABELLED_SQL}, t AS (SELECT unnest({thresholds}) AS threshold),
counts AS (SELECT threshold, count(*) FILTER (label <> 0 AND p >= threshold) AS tp, count(*) FILTER (label = 0 AND p < threshold) AS tn, count(*) FILTER (label = 0 AND p >= threshold) AS fp, count(*) FILTER (label <> 0 AND p < threshold) AS fn FROM x, t GROUP BY threshold),
ratios AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS re FROM counts)
SELECT threshold::DOUBLE AS threshold, tp, tn, fp, fn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1 FROM ratios"""


def _rounded(rows):
    return rows.select("threshold", "tp", "tn", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


query("h1_evaluate", _metrics_sql("[0.5]"))(lambda s, d: _rounded(evaluate.evaluate(_labelled(s, d), 0.5)))
SWEEP = [i / 20 for i in range(1, 20)]
query("h2_evaluate_sweep", _metrics_sql("[" + ", ".join(map(str, SWEEP)) + "]"))(lambda s, d: _rounded(evaluate.evaluate_sweep(_labelled(s, d), SWEEP)))
query("h3_dataset_balance", f"WITH {SAMPLES_SQL} SELECT count(*) AS evaluated, count(*) FILTER (label <> 0) AS label_1, count(*) FILTER (label = 0) AS label_0 FROM samples")(lambda s, d: evaluate.dataset_balance(inputs.samples(s, d)))
KIND = "CASE WHEN category IS NULL THEN 'missing' WHEN lower(trim(category)) = 'unknown' THEN 'unknown' ELSE 'other' END"
query("h4_category_stats", f"""WITH {SAMPLES_SQL}, k AS (SELECT {KIND} AS k FROM samples), c AS (SELECT count(*) AS total, count(*) FILTER (k = 'unknown') AS unknown, count(*) FILTER (k = 'missing') AS missing, count(*) FILTER (k = 'other') AS other FROM k)
SELECT *, round(unknown / total, 6) AS unknown_share, round(missing / total, 6) AS missing_share, round(other / total, 6) AS other_share FROM c""")(lambda s, d: evaluate.category_stats(inputs.samples(s, d)).select("total", "unknown", "missing", "other", *[F.round(f"{k}_share", 6).alias(f"{k}_share") for k in ("unknown", "missing", "other")]))
STAMP = "'%Y-%m-%d %H:%M:%S'"
query("h5_unknown_breakdown", f"WITH {SAMPLES_SQL} SELECT count(*) AS unknown, count(*) FILTER (label = 0) AS label_0, count(*) FILTER (label <> 0) AS label_1, 0::BIGINT AS missing_date, strftime(min(created_at), {STAMP}) AS first_at, strftime(max(created_at), {STAMP}) AS last_at FROM samples WHERE {KIND} = 'unknown'")(lambda s, d: evaluate.unknown_breakdown(inputs.samples(s, d)).withColumn("first_at", F.date_format("first_at", "yyyy-MM-dd HH:mm:ss")).withColumn("last_at", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss")))
DAYS = f"{SAMPLES_SQL}, days AS (SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) FILTER ({KIND} = 'unknown') AS unknown, count(*) AS total FROM samples GROUP BY ALL), shares AS (SELECT day, unknown, total, unknown / total AS ratio FROM days)"


def _days(rows):
    return rows.select(F.col("day").cast("string").alias("day"), "unknown", "total", F.round("ratio", 6).alias("ratio"))


query("h6_unknown_by_day", f"WITH {DAYS} SELECT day, unknown, total, round(ratio, 6) AS ratio FROM shares")(lambda s, d: _days(evaluate.unknown_by_day(inputs.samples(s, d))))
query("h7_unknown_recent", f"WITH {DAYS} SELECT day, unknown, total, round(ratio, 6) AS ratio FROM shares WHERE day >= '2024-01-22'")(lambda s, d: _days(evaluate.unknown_recent(inputs.samples(s, d), 10, "2024-02-01 00:00:00")))
query("h8_top_days", f"WITH {DAYS} SELECT day, unknown, total, round(ratio, 6) AS ratio FROM shares WHERE unknown > 0 ORDER BY unknown DESC, day LIMIT 10")(lambda s, d: _days(evaluate.top_days(inputs.samples(s, d))))
query("h8_top_days_ratio", f"WITH {DAYS} SELECT day, unknown, total, round(ratio, 6) AS ratio FROM shares WHERE unknown > 0 AND total >= 5 ORDER BY shares.ratio DESC, day LIMIT 10")(lambda s, d: _days(evaluate.top_days(inputs.samples(s, d), "ratio", 10, 5)))

# I. streaming forms, run to the end of the tables


def _files(spark, df, name):
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _finish(spark, writer, timers=False):
    from modq.streaming import jobs

    jobs.run_available(spark, writer, timers)


@query("i1_moderate_stream", f"WITH {FLOW_SQL} SELECT id, profile, decision, source FROM flow")
def _(spark, d):
    from modq.streaming import jobs

    terms, intercept = _model(spark, d)
    sink, history = fresh_path(spark, "decisions"), inputs.samples(spark, d)
    stream = _files(spark, inputs.texts(spark, d), "texts")
    _finish(spark, jobs.moderate_stream(stream, inputs.keywords(spark), lambda t: moderate.score_terms(t, terms, intercept), lambda: history, sink, fresh_path(spark, "state"), max_text=MOST_TEXT, review_rate=0.3))
    return spark.read.parquet(sink).select("id", "profile", "decision", "source")


@query("i2_dedupe_texts_stream", "SELECT lang AS profile, md5(text) AS text_hash FROM documents GROUP BY ALL")
def _(spark, d):
    from modq.streaming import jobs

    rows = inputs.texts(spark, d).withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    sink = fresh_path(spark, "deduped")
    stream = jobs.dedupe_texts_stream(_files(spark, rows, "texts"))
    _finish(spark, stream.select("profile", "text_hash").writeStream.format("parquet").option("path", sink).option("checkpointLocation", fresh_path(spark, "state")))
    return spark.read.parquet(sink)


@query("i3_reassemble_streams_stream", ORACLE_SQL["e3_reassemble_streams"])
def _(spark, d):
    from modq.streaming import jobs

    sink = fresh_path(spark, "streams")
    chunks = inputs.stream_chunks(spark, d).withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    _finish(spark, jobs.reassemble_streams_stream(_files(spark, chunks, "chunks"), sink, fresh_path(spark, "state")))
    return spark.read.parquet(sink).select("stream_id", "text", "finish_reason", "done")


@query("i4_running_counts_stream", f"WITH {SAMPLES_SQL} SELECT profile, label, count(*) AS n FROM samples GROUP BY ALL")
def _(spark, d):
    from modq.operators import sample_table
    from modq.streaming import jobs

    rows, counts = inputs.samples(spark, d), sample_table.counts_table(spark, fresh_path(spark, "counts"))
    path, state = fresh_path(spark, "samples"), fresh_path(spark, "state")
    for half in (0, 1):  # a batch for each half, of as many files as it has: the second changes totals that the first has written
        rows.where(F.col("id") % 2 == half).write.mode("append").parquet(path)
        _finish(spark, jobs.upsert_counts_stream(spark.readStream.schema(rows.schema).parquet(path), counts, state))
    return counts.read()


#: A verdict of each document of its own, so that a repeat's would differ from its text's first.
OWN_VERDICTS = "SELECT doc_id AS id, lang AS profile, md5(text) AS text_hash, (doc_id % 100) / 100.0::DOUBLE AS p FROM documents"


@query("i2_reuse_verdicts_stream", f"""WITH d AS ({OWN_VERDICTS}), f AS (SELECT profile, text_hash, min(id) AS first, arg_min(p, id) AS p FROM d GROUP BY ALL)
SELECT d.id, d.profile, d.text_hash, CASE WHEN f.p < 0.2 THEN 'allow' WHEN f.p > 0.8 THEN 'block' ELSE 'uncertain' END AS decision, round(f.p, 6) AS p, d.id <> first AS reused FROM d JOIN f USING (profile, text_hash)""")
def _(spark, d):
    from modq.streaming import jobs

    rows = inputs.texts(spark, d).select("id", "profile", F.md5("text").alias("text_hash"), ((F.col("id") % 100) / 100.0).alias("p"))
    decided = moderate.decide(rows).withColumn("source", F.lit("local"))
    middle = rows.agg(F.percentile_approx("id", 0.5)).first()[0]
    path, sink, state = fresh_path(spark, "decided"), fresh_path(spark, "reused"), fresh_path(spark, "state")
    for half in (F.col("id") <= middle, F.col("id") > middle):  # a batch for each half, of as many files as it has: repeats within a batch and of an earlier one
        decided.where(half).write.mode("append").parquet(path)
        out = jobs.reuse_verdicts_stream(spark.readStream.schema(decided.schema).parquet(path))
        _finish(spark, out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state))
    return spark.read.parquet(sink).select("id", "profile", "text_hash", "decision", F.round("p", 6).alias("p"), "reused")


# the sample store that changes

@query("c13_retain_in_place", f"WITH {SAMPLES_SQL}, {BY_PROFILE}, t AS (SELECT profile, count(*) AS total FROM samples GROUP BY profile), kept AS (SELECT r.* FROM r JOIN t USING (profile) WHERE total <= 60 OR k <= 30) SELECT profile, text_hash, max(id) AS pointer, count(*) AS samples FROM kept GROUP BY ALL")
def _(spark, d):
    from modq.operators import sample_table

    store_ = sample_table.sample_table(spark, fresh_path(spark, "sample-table"))
    sample_table.import_samples(store_, inputs.samples(spark, d))
    version = sample_table.retain(store_, _limits(spark, d).select("profile", F.lit(60).alias("most")))
    have = store_.read(version).groupBy("profile", "text_hash").agg(F.count("*").alias("samples"))
    return sample_table.pointers(store_, version).withColumnRenamed("id", "pointer").join(have, ["profile", "text_hash"])


@query("c5_lookup_in_table", ORACLE_SQL["c5_lookup_by_text"])
def _(spark, d):
    from modq.operators import sample_table

    store_ = sample_table.sample_table(spark, fresh_path(spark, "sample-table"))
    s = inputs.samples(spark, d)
    for half in (0, 1):
        sample_table.import_samples(store_, s.where(F.col("id") % 2 == half))
    return sample_table.lookup(store_, inputs.texts(spark, d)).select("id", "hit_id", "hit_label")


@query("i1_learning_loop", f"WITH {VERDICTS}, said AS (SELECT d.lang AS profile, md5(d.text) AS text_hash, v.toxic::INT AS label, v.source AS category FROM verdicts v JOIN documents d USING (doc_id) WHERE doc_id % 3 <> 0 AND doc_id = (SELECT min(x.doc_id) FROM documents x WHERE x.lang = d.lang AND x.text = d.text)) SELECT profile, text_hash, label, category FROM said")
def _(spark, d):
    """Reviewers' verdicts on each text's first document meet the queue in a stream, and become samples."""
    from modq.operators import sample_table
    from modq.streaming import jobs

    first = Window.partitionBy("lang", "text_hash").orderBy("doc_id")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    firsts = table(spark, d, "documents").withColumn("text_hash", F.md5("text")).withColumn("nth", F.row_number().over(first)).where("nth = 1").select("doc_id", "text_hash")
    judged = _verdicts(spark, d).join(firsts, "doc_id")
    queue = judged.select(F.col("lang").alias("profile"), "text_hash", "text", at.alias("queued_at"))
    verdicts = judged.select(F.col("lang").alias("profile"), "text_hash", "content", (at + F.expr("interval 5 minutes")).alias("judged_at"))
    samples = sample_table.sample_table(spark, fresh_path(spark, "sample-table"))
    _finish(spark, jobs.learn_stream(_files(spark, queue, "queue"), _files(spark, verdicts, "verdicts"), samples, fresh_path(spark, "rejects"), fresh_path(spark, "state")))
    return samples.read().select("profile", "text_hash", "label", "category")
