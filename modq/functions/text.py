"""Text functions as column expressions; only the hash bucket needs an Arrow UDF."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what replaces the middle of a long text.
MIDDLE = "\n...[中间省略]...\n"
#: The ranges of CJK characters and the weights of the token estimate.
CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{2CEB0}-\x{2EBEF}\x{30000}-\x{3134F}]"
PER_OTHER, PER_CJK, PER_SPACE, PER_TEXT = 0.28, 1.4, 0.15, 4.0
SPACES = r"\p{IsWhite_Space}+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def clean_newlines(text: Column) -> Column:
    return F.translate(text, "\r\n", "  ")


def normalize_spaces(text: Column) -> Column:
    """Each run of Unicode white space becomes one space; no trim."""
    return F.regexp_replace(text, SPACES, " ")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def trimmed(text: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.regexp_replace(text, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")


def ws_tokens(text: Column, split: bool = True) -> Column:
    """Lower-case tokens between white space; split False: the lower-case text as one token."""
    if not split:
        return F.filter(F.array(F.lower(text)), lambda x: x != "")
    return F.filter(F.split(F.lower(text), SPACES), lambda x: x != "")


def _grams(units: Column, least: int, most: int, glue: str) -> Column:
    """All runs of least to most units; units is computed once."""

    def of(u: Column) -> Column:
        def runs(n: int) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(F.size(u) - n + 1, F.lit(1)))
            return F.when(F.size(u) >= n, F.transform(starts, lambda i: F.array_join(F.slice(u, i, n), glue))).otherwise(F.array().cast("array<string>"))

        return F.concat(*map(runs, range(least, most + 1)))

    return F.transform(F.array(units), of)[0]


def char_ngrams(text: Column, least: int, most: int) -> Column:
    """Runs of least to most code points; each length is one pass of a compiled search. Null text: none."""
    # a match takes one code point and looks ahead at the run that begins there
    runs = lambda n: F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))
    return F.concat(*[F.coalesce(runs(n), F.array().cast("array<string>")) for n in range(least, most + 1)])


def word_ngrams(text: Column, least: int, most: int) -> Column:
    """Runs of least to most white-space tokens, joined by one space."""
    return _grams(F.filter(F.split(text, SPACES), lambda c: c != ""), least, most, " ")


def murmur3_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Signed MurmurHash3 x86 32, seed 0, of data[start:end] each; spans of equal length are hashed together."""
    out, lengths = np.zeros(starts.size, np.uint32), ends - starts
    c1, c2 = np.uint32(0xCC9E2D51), np.uint32(0x1B873593)
    rotate = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        rows = np.zeros((at.size, -(-n // 4) * 4), np.uint8)
        rows[:, :n] = data[starts[at][:, None] + np.arange(n)]
        blocks = rows.view("<u4")
        h = np.zeros(at.size, np.uint32)
        for b in range(n // 4):
            h = rotate(h ^ (rotate(blocks[:, b] * c1, 15) * c2), 13) * np.uint32(5) + np.uint32(0xE6546B64)
        if n % 4:
            h ^= rotate(blocks[:, -1] * c1, 15) * c2
        h ^= np.uint32(n)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        out[at] = h ^ (h >> np.uint32(16))
    return out.view(np.int32)


def murmur3_32(texts: list[bytes]) -> np.ndarray:
    """murmur3_spans of whole strings."""
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    return murmur3_spans(np.frombuffer(b"".join(texts), np.uint8), np.append(0, ends[:-1])[: len(texts)], ends)


def hash_bucket(gram: Column, n_features: int, alternate_sign: bool = True) -> Column:
    """struct(bucket, sign): abs(h) mod n_features, and -1 for negative h with alternate_sign.

    An Arrow UDF over whole batches; apply it to distinct grams.
    """

    @F.pandas_udf("bucket int, sign int")
    def bucket(grams: pd.Series) -> pd.DataFrame:
        h = murmur3_32([g.encode() for g in grams]).astype(np.int64)
        return pd.DataFrame({"bucket": (np.abs(h) % n_features).astype(np.int32), "sign": np.where(alternate_sign & (h < 0), -1, 1).astype(np.int32)})

    return bucket(gram)


def sigmoid(x: Column) -> Column:
    """Stable for large values of either sign."""
    return F.when(x >= 0, 1.0 / (1.0 + F.exp(-x))).otherwise(F.exp(x) / (1.0 + F.exp(x)))


def text_hash(text: Column) -> Column:
    return F.md5(text)


def truncate_middle(text: Column, most: int | Column) -> Column:
    """Texts of more than `most` code points keep the first 2 * most / 3 and the last of the rest."""
    most = most if isinstance(most, Column) else F.lit(most)
    front = F.floor(most * 2 / 3).cast("int")
    return F.when(F.length(text) > most, F.concat(F.left(text, front), F.lit(MIDDLE), F.right(text, most.cast("int") - front))).otherwise(text)


def render_prompt(template: Column, text: Column) -> Column:
    """The template with {{text}} replaced by the HTML-escaped text."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return F.replace(template, F.lit("{{text}}"), text)


def estimate_tokens(text: Column) -> Column:
    """A token estimate from classes of characters; null for blank text."""
    t = trimmed(text)
    spaces = F.regexp_count(t, F.lit(r"\p{IsWhite_Space}")).cast("double")
    cjk = F.regexp_count(t, F.lit(CJK)).cast("double")
    other = F.length(t).cast("double") - spaces - cjk
    estimate = F.ceil(F.lit(PER_OTHER) * other + F.lit(PER_CJK) * cjk + F.lit(PER_SPACE) * spaces + F.lit(PER_TEXT))
    return F.when(t != "", F.greatest(estimate, F.lit(1))).cast("long")


def category_class(category: Column) -> Column:
    return F.when(category.isNull(), "missing").when(F.lower(trimmed(category)) == "unknown", "unknown").otherwise("other")


def parse_created_at(raw: Column) -> Column:
    """A timestamp of the strict form 2024-01-31 00:00:00; anything else is null."""
    t = trimmed(raw)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss")))


def is_kind(value: Column, kind: str) -> Column:
    """Whether a VARIANT is of this kind, as its schema says: STRING, BOOLEAN, ARRAY, OBJECT."""
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def string_of(value: Column, path: str = "$") -> Column:
    """The string at a path of a VARIANT; null where it is absent or anything but a string."""
    inner = F.try_variant_get(value, path, "variant") if path != "$" else value
    return F.when(is_kind(inner, "STRING"), F.try_variant_get(inner, "$", "string"))


def items_of(value: Column, path: str = "$") -> Column:
    """The array at a path of a VARIANT as array<variant>; null where it is no array."""
    inner = F.try_variant_get(value, path, "variant") if path != "$" else value
    return F.when(is_kind(inner, "ARRAY"), F.try_variant_get(inner, "$", "array<variant>"))


def json_of(text: Column) -> Column:
    """A JSON text as VARIANT; null if it is none. Unlike try_parse_json(), which stops behind the first value, nothing but white space may follow it."""

    # as the first of two items, of which the second is known: what follows the value would stand between them
    def first(t: Column) -> Column:
        both = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), t, F.lit(',"'), F.md5(t), F.lit('"]'))), "$", "array<variant>")
        whole = lambda b: F.when((F.size(b) == 2) & (F.try_variant_get(F.get(b, F.lit(1)), "$", "string") == F.md5(t)), F.get(b, F.lit(0)))
        return F.get(F.transform(F.array(both), whole), F.lit(0))

    # in lambdas, so that the text is parsed once, however often the value is used
    return F.get(F.transform(F.array(text), first), F.lit(0))


def parse_verdict(content: Column) -> Column:
    """struct(violation, category, reason, confidence, parse_error) from the outermost braces of a reply."""
    start = F.instr(content, "{")
    end = F.length(content) - F.instr(F.reverse(content), "}") + 1
    inside = F.when((start > 0) & (F.instr(content, "}") > 0) & (end > start), F.substring(content, start, end - start + 1))
    v = json_of(inside)
    flag = F.try_variant_get(v, "$.violation", "variant")
    number = F.try_variant_get(v, "$.confidence", "variant")
    is_number = F.coalesce(F.schema_of_variant(number).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)"), F.lit(False))
    good = is_kind(v, "OBJECT")
    return F.struct(
        F.when(good, F.when(is_kind(flag, "BOOLEAN"), F.try_variant_get(flag, "$", "boolean")).otherwise(F.lit(False))).alias("violation"),
        F.when(good, string_of(v, "$.category")).alias("category"),
        F.when(good, string_of(v, "$.reason")).alias("reason"),
        F.when(good & is_number, F.try_variant_get(number, "$", "double")).alias("confidence"),
        F.when(~good, F.lit("no JSON object in the reply")).alias("parse_error"),
    )


def content_text(value: Column) -> Column:
    """A string as it is, an array's parts of type text joined by newlines, else empty."""
    parts = F.filter(F.transform(F.filter(items_of(value), lambda p: string_of(p, "$.type") == "text"), lambda p: string_of(p, "$.text")), lambda t: t.isNotNull())
    return F.coalesce(string_of(value), F.array_join(parts, "\n"), F.lit(""))
