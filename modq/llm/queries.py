"""One query per operator over the whole documents table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modq.llm import exact_dedup, line_dedup, media, merkle, mixing, near_dedup, packing, quality, rules, secret_scan, substring_dedup, token_counts, whitening
from modq.session import prepare, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"), with_text=False)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.media_columns(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "q_words.n_words", "q_parts.word_chars", "q_parts.n_symbols", "q_parts.n_dup_lines", "q_words.n_repeat_words", "base_failed", "kept")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner: the source; repository: the source's documents of a language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("owner"), F.concat_ws("/", "source", "lang").alias("repository"))
    return secret_scan.with_digests(secret_scan.secrets(docs))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3, threshold=85)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.checked(merkle.manifest(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_quality": op2_quality,
    "op3_token_counts": op3_token_counts,
    "op4_mixing": op4_mixing,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_media": op6_media,
    "op7_rules": op7_rules,
    "op8_secrets": op8_secrets,
    "op9_near_dedup": op9_near_dedup,
    "op10_line_dedup": op10_line_dedup,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_whitening": op12_whitening,
    "op13_merkle": op13_merkle,
}

ORACLE_SQL = {
    "op4_mixing": r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM totals),
weighed AS (SELECT *, [3, 1, 2][(place % 3) + 1]::BIGINT AS weight, 2 * source_size AS cap FROM ranked),
levels AS (
  SELECT *, cap / weight AS ratio,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighed WINDOW w AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
best AS (SELECT min_by(level, ratio) AS level FROM levels WHERE level <= ratio),
targets AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(weight * (SELECT level FROM best), cap)::DOUBLE) AS target FROM levels),
placed AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, round(t.target)::BIGINT AS budget,
    coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.k, r.doc_id NULLS FIRST, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
cuts AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS n_full FROM placed)
SELECT doc_id, size, source_size, target,
  (n_full * size + greatest(0, least(size, budget - n_full * source_size - before)))::BIGINT AS taken
FROM cuts
""",
    "op5_substring_dedup": r"""
WITH docs AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS MATERIALIZED (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs)),
firsts AS (SELECT k, min(doc_id) AS low FROM windows GROUP BY k),
gone AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN firsts USING (k) WHERE doc_id > low),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id)
""",
    "op9_near_dedup": r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS s FROM docs),
sizes AS (SELECT doc_id, len(s)::BIGINT AS n_shingles FROM sets),
items AS MATERIALIZED (SELECT doc_id, unnest(s) AS v FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM items a JOIN items b ON a.v = b.v AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * n >= 85 * (x.n_shingles + y.n_shingles - n)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sizes UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.other = e.a)
SELECT s.doc_id, s.n_shingles, min(r.other) AS component_id, s.doc_id = min(r.other) AS kept
FROM sizes s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.n_shingles
""",
    "op11_exact_dedup": r"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256 FROM t WINDOW w AS (PARTITION BY t)
""",
    "op13_merkle": r"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v FROM range(256) t(i)),
crcs AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM crc),
leaves AS MATERIALIZED (
  SELECT doc_id, lang, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END) AS other,
    coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')]), lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::INT])), 4294967295::BIGINT) % 3 = 0, false) AS tampered
  FROM (SELECT *, list_aggregate([CASE WHEN v IS NULL THEN '-' ELSE strlen(v) || ':' || v END FOR v IN [doc_id::VARCHAR, source, lang, n_chars::VARCHAR]], 'string_agg', '') AS head FROM documents), crcs),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
levels(grp, k, nodes) AS (
  SELECT lang, 0, list(leaf ORDER BY place) FROM placed GROUP BY lang
  UNION ALL SELECT grp, k + 1, [sha256(array_to_string(nodes[i + 1:i + 8], '')) FOR i IN range(0, len(nodes), 8)] FROM levels WHERE len(nodes) > 1),
held AS MATERIALIZED (SELECT * FROM levels),
tops AS MATERIALIZED (SELECT grp, nodes[1] AS subroot, row_number() OVER (ORDER BY encode(grp) NULLS FIRST) - 1 AS place FROM held WHERE len(nodes) = 1),
upper(k, nodes) AS (
  SELECT 0, list(subroot ORDER BY place) FROM tops
  UNION ALL SELECT k + 1, [sha256(array_to_string(nodes[i + 1:i + 8], '')) FOR i IN range(0, len(nodes), 8)] FROM upper WHERE len(nodes) > 1),
above AS MATERIALIZED (SELECT * FROM upper),
sides AS (
  SELECT p.lang AS grp, p.place AS leaf_at, h.k, array_to_string(nodes[(pos // 8) * 8 + 1:pos], '') AS before, array_to_string(nodes[pos + 2:(pos // 8) * 8 + 8], '') AS after
  FROM placed p JOIN held h ON h.grp IS NOT DISTINCT FROM p.lang AND len(h.nodes) > 1, LATERAL (SELECT p.place // (8 ** h.k)::BIGINT AS pos)),
top_sides AS (
  SELECT t.grp, a.k, array_to_string(nodes[(pos // 8) * 8 + 1:pos], '') AS before, array_to_string(nodes[pos + 2:(pos // 8) * 8 + 8], '') AS after
  FROM tops t JOIN above a ON len(a.nodes) > 1, LATERAL (SELECT t.place // (8 ** a.k)::BIGINT AS pos)),
own AS (SELECT grp, leaf_at, list({'b': before, 'a': after} ORDER BY k) AS path FROM sides GROUP BY ALL),
shared AS (SELECT grp, list({'b': before, 'a': after} ORDER BY k) AS path FROM top_sides GROUP BY ALL),
paths AS MATERIALIZED (
  SELECT p.doc_id, p.leaf, t.subroot, (SELECT nodes[1] FROM above WHERE len(nodes) = 1) AS root, CASE WHEN tampered THEN other ELSE leaf END AS now, list_concat(coalesce(o.path, []), coalesce(s.path, [])) AS path, row_number() OVER () AS r
  FROM placed p JOIN tops t ON t.grp IS NOT DISTINCT FROM p.lang LEFT JOIN own o ON o.grp IS NOT DISTINCT FROM p.lang AND o.leaf_at = p.place LEFT JOIN shared s ON s.grp IS NOT DISTINCT FROM p.lang),
folds(r, k, node) AS (
  SELECT r, 0, now FROM paths UNION ALL SELECT f.r, k + 1, sha256(path[k + 1].b || node || path[k + 1].a) FROM folds f JOIN paths p ON p.r = f.r AND k < len(path)),
ends AS (SELECT r, arg_max(node, k) AS folded_root FROM folds GROUP BY r)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string([x.b || x.a FOR x IN path], '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM paths JOIN ends USING (r)
""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def ready(query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return query(spark, sf_dir)

        return run

    return {name: ready(q) for name, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
