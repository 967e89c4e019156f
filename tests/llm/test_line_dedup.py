"""Lines that differ late in a word, near copies, and how often similar short lines meet in a band."""

import random
import re
from collections import Counter, defaultdict
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from modq.llm import line_dedup

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def components_of(n, links):
    name = list(range(n))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for a, b in links:
        name[root(b)] = root(a)
    return [root(i) for i in range(n)]


def by_value(name):
    groups = defaultdict(list)
    for k, v in name.items():
        groups[v].append(k)
    return groups.values()


def kept(spark, lines):
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    return {r["doc_id"] for r in line_dedup.dedup_lines(docs).where("n_removed_lines = 0").collect()}


def test_lines_that_differ_late_in_a_word_stay(spark):
    lines = ["https://example.com/a", "https://example.com/totally-other", "Licence: https://opensource.org/licenses/MIT", "Licence: https://opensource.org/licenses/Apache-2.0"]
    lines += ["日本語の文章には空白がありません。これは一つ目です", "日本語の文章には空白がありません。全く別の内容がここに続きます", "abc", "abd"]
    assert kept(spark, lines) == set(range(len(lines)))


def test_near_copies_go(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(3, 9)))
    lines = []
    for n in [16] * 20 + [32] * 20:
        words = [word() for _ in range(n)]
        middle = words[n // 2]
        lines += [" ".join(words), " ".join([*words[: n // 2], f"#{middle[1:]}", *words[n // 2 + 1 :]])]
    assert kept(spark, lines) == set(range(0, len(lines), 2))


@pytest.mark.parametrize("both, own", [(4, 1), (8, 2), (12, 3), (16, 4), (32, 8), (48, 12), (200, 50)])
def test_bands_find_similar_sets(spark, both, own):
    """Sets of which both hashes are common and own are one set's alone, at similarity 0.8: the chance to meet is what BANDS and ROWS promise."""
    n, least = 2000, 1 - (1 - 0.8**line_dedup.ROWS) ** line_dedup.BANDS
    assert least > 0.993
    some = lambda kind, k: F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.xxhash64("h", F.lit(kind), i))
    ids = spark.range(n).select(F.col("id").alias("h"))
    small = ids.select("h", F.lit(0).alias("g"), F.sort_array(some(0, both)).alias("hashes"))
    large = ids.select("h", F.lit(1).alias("g"), F.sort_array(F.concat(some(0, both), some(1, own))).alias("hashes"))
    signed = line_dedup.signatures(small.union(large))
    one, two = signed.where("g = 0").select("h", F.col("bands").alias("a")), signed.where("g = 1").select("h", F.col("bands").alias("b"))
    met = one.join(two, "h").where(F.arrays_overlap("a", "b")).count()
    assert met / n > least - 4 * (least * (1 - least) / n) ** 0.5


def test_recall_on_whole_table(spark):
    """Lines of sf0.001 against all pairs of them: nine links of ten at least, and nothing that isn't one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lines = sorted({x for r in docs.select("text").collect() for x in (r["text"] or "").split("\n") if WORD.search(x)})
    sets = [frozenset(x[i : i + 5] for i in range(max(1, len(x) - 4))) for x in lines]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    links = set()
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in holders[x] if j > i)
        links |= {(i, j) for j, c in common.items() if 100 * c >= 80 * (len(s) + len(sets[j]) - c)}
    exact = components_of(len(lines), links)
    table = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    found = {r["h"]: r["ch"] for r in line_dedup.line_components(table).collect()}
    name = {r["doc_id"]: found.get(r["h"], r["h"]) for r in line_dedup.line_ids(table).select("doc_id", "h").collect()}
    together = [name[a] == name[b] for a, b in links]
    assert len(links) > 20 and sum(together) >= 0.9 * len(links)
    assert all(exact[i] == exact[j] for group in by_value(name) for i, j in pairwise(group))


def test_rows_without_an_id_are_told_apart(spark):
    rows = [(1, "first line of all here\nalpha beta gamma delta"), (None, "first line of all here\nsome other words entirely"), (None, "totally unique opening line zebra\nfirst line of all here"), (None, None), (None, "")]
    got = {r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {rows[0][1], "some other words entirely", "totally unique opening line zebra", None, ""}


def test_rows_of_one_id(spark):
    rows = [(1, "a line that is repeated\nb"), (1, "a line that is repeated\nb"), (1, "another text of the id\na line that is repeated"), (2, "a line that is repeated\nc")]
    got = sorted(r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    kept_in_pair = got.count("a line that is repeated\nb")
    assert kept_in_pair in (0, 2) and "c" in got and sum("a line that is repeated" in x for x in got) == (2 if kept_in_pair else 1)


def test_repeated_patterns_of_any_length_meet(spark):
    assert kept(spark, ["=" * 40, "=" * 400, "ab" * 20, "ab" * 2000, "A" * 16 + "B" * 30, "A" * 46]) == {0, 2, 4, 5}
