"""Secret scans with corpus-wide ownership frequency."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modq.session import prepare, written

#: Fixed patterns of the base kinds, in their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "live")
#: What an assignment's name has, in lower case: a text without any of them has no assignment.
NAMES = ("passw", "secret", "token", "apikey", "api_key")
#: The method's own candidates: runs of credential characters that look random.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST_BITS, MOST_OWNERS, MOST_REPOSITORIES = 3.5, 1, 3
SPAN = "kind int, start int, end int, hash string"


def looks_live(value: str) -> bool:
    """Digits and letters of both cases, and at least LEAST_BITS of entropy a character."""
    if not (any(c.isdigit() for c in value) and any(c.islower() for c in value) and any(c.isupper() for c in value)):
        return False
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) >= LEAST_BITS


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value), code points, per kind leftmost and without overlap.

    Matches that are too short are consumed, then dropped: a run of hexadecimal digits or of access
    characters can't hold a longer one, so for these only long runs are looked for.
    """
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [(0, *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(1, *m.span(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return out + [(2, *m.span(), m[0]) for m in HEX.finditer(text)]


def candidates(text: str, base: list[tuple]) -> list[tuple[int, int, int, str]]:
    """Random-looking runs that no base span overlaps, as kind 3."""
    out, waiting, last = [], sorted((s, e) for _, s, e, _ in base), 0
    waiting.reverse()
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while waiting and waiting[-1][0] < b:  # last: where base spans that begin before b have ended
            last = max(last, waiting.pop()[1])
        if last <= a and looks_live(m[0]):
            out.append((3, a, b, m[0]))
    return out


def scan_spans(docs: DataFrame) -> DataFrame:
    """row, doc_id, owner, repository, spans (kind, start, end, SHA-256 of the credential itself) for every row of docs."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.string())]))
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                found = base_spans(text) if text else []
                found += candidates(text, found) if text else []
                rows.append([{"kind": k, "start": s, "end": e, "hash": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()} for k, s, e, v in found])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "doc_id", "owner", "repository")), pa.array(rows, kind)], names=["row", "doc_id", "owner", "repository", "spans"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repository", "text")
    return rows.mapInArrow(scan, f"row long, doc_id long, owner string, repository string, spans array<struct<{SPAN.replace(' int', ':int').replace(' string', ':string')}>>")


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_owners, n_repositories, n_rows, copied: how widely each candidate stands in the corpus.

    Distinct (hash, owner, repository) come first, so that a credential that stands in a third of
    all rows is counted from few rows in each task.
    """
    each = found.select("owner", "repository", F.explode("spans").alias("s")).groupBy(F.col("s.hash").alias("hash"), "owner", "repository").agg(F.count("*").alias("n"))
    owners = each.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    all_ = owners.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories"), F.sum("n").alias("n_rows"))
    return all_.withColumn("copied", (F.col("n_owners") > MOST_OWNERS) | (F.col("n_repositories") > MOST_REPOSITORIES))


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, and all_spans: array of (kind, start, end, hash, n_owners, n_repositories, n_rows, verdict) by start, then kind.

    docs: doc_id, text, owner, repository. Kinds: KINDS. Base spans (assign, access, hex) always stay. The
    method adds, as live, random-looking runs whose credential belongs to one owner and at most
    MOST_REPOSITORIES repositories; more widely copied ones are taken for examples and left out. verdict says which
    of the two each span's credential is: example or live.

    Null or empty text: no spans. Null owner or repository: one owner or repository of its own. Repositories of two owners with one name are two. Null doc_id: kept.
    Repeated rows: one result each, counted in n_rows. Empty table: no rows. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    found = written(scan_spans(docs), "spans")
    owned = ownership(found)
    single = found.select("row", F.explode("spans").alias("s")).select("row", "s.*").join(owned, "hash")
    single = single.where((F.col("kind") < 3) | ~F.col("copied"))
    verdict = F.when(F.col("copied"), "example").otherwise("live")
    per_row = single.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "hash", "n_owners", "n_repositories", "n_rows", verdict.alias("verdict")))).alias("all_spans"))
    out = found.select("row", "doc_id").join(per_row, "row", "left")
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,hash:string,n_owners:bigint,n_repositories:bigint,n_rows:bigint,verdict:string>>")
    return out.select("doc_id", F.coalesce("all_spans", empty).alias("all_spans"))


def span_list(spans) -> "F.Column":
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")


def with_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans from secrets()' rows, and what the ownership of each span's credential is in the whole corpus:
    owners, a row of (kind, start, end, n_owners, n_repositories, n_occurrences, verdict) for each of spans, in that order; n_live and n_example, spans
    of either verdict; most_owners, of any of its credentials."""
    of = lambda k: F.size(F.filter("all_spans", lambda s: s.kind == k)).cast("long")
    said = lambda v: F.size(F.filter("all_spans", lambda s: s.verdict == v)).cast("long")
    base = span_list(F.filter("all_spans", lambda s: s.kind < 3))
    names = F.array(*map(F.lit, KINDS))
    owners = F.transform("all_spans", lambda s: F.struct(F.element_at(names, s.kind + 1).alias("kind"), s.start.alias("start"), s.end.alias("end"), s.n_owners.alias("n_owners"), s.n_repositories.alias("n_repositories"), s.n_rows.alias("n_occurrences"), s.verdict.alias("verdict")))
    most = F.coalesce(F.array_max(F.transform("all_spans", lambda s: s.n_owners)), F.lit(0)).cast("long")
    return found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), span_list(F.col("all_spans")).alias("spans"),
        said("live").alias("n_live"), said("example").alias("n_example"), most.alias("most_owners"), owners.alias("owners"),
    )
