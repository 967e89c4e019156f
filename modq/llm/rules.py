"""Quality rules: a learned decision list of Spark conditions, DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modq.session import written

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
GRAM = 8
#: Ratios that rules may test, each a function of the statistics.
FEATURES = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "distinct_ratio", "upper_ratio", "mark_ratio", "word_length")
#: Candidate thresholds of a feature: so many quantiles of either label. Labelled rows that rules are learned from, at most (smallest hash).
QUANTILES, TRAIN_ROWS = 12, 50_000
MOST_RULES, MOST_TERMS, LEAST_PRECISION, LEAST_ROWS, MARGIN = 6, 3, 0.9, 3, 0.02


def repeated_words(hashes: Column, n_words: Column) -> Column:
    """Words in GRAM-word windows that stand twice or more in a text; hashes: of its windows, in order.

    Without equal windows: 0. Else windows are sorted by (hash, position); those next to an equal one are repeated, and
    each covers the words up to the next repeated window's start, GRAM at most.
    """

    def covered(sorted_windows: Column) -> Column:
        n = F.size(sorted_windows)
        same = lambda i: sorted_windows[i].getField("h")
        hit = F.filter(sorted_windows, lambda w, i: ((i > 0) & (w.getField("h") == same(F.greatest(i - 1, F.lit(0))))) | ((i < n - 1) & (w.getField("h") == same(F.least(i + 1, n - 1)))))
        starts = F.array_sort(F.transform(hit, lambda w: w.getField("p")))
        return let(starts, lambda s: F.aggregate(F.transform(s, lambda p, i: F.when(i == F.size(s) - 1, F.lit(GRAM)).otherwise(F.least(F.lit(GRAM), s[F.least(i + 1, F.size(s) - 1)] - p))), F.lit(0), lambda a, x: a + x))

    windows = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return F.when(n_words < GRAM, F.lit(0)).when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(windows, covered))


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def text_stats(docs: DataFrame) -> DataFrame:
    """docs' columns and q_stats: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_distinct_words, n_upper, n_marks."""
    text = F.coalesce("text", F.lit(""))

    def stats(words: Column) -> Column:
        n = F.size(words)
        # the if keeps sequence() from counting down in short texts
        hashes = F.when(n >= GRAM, F.transform(F.sequence(F.lit(1), F.greatest(n - GRAM + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, GRAM)))).otherwise(F.array().cast("array<bigint>"))
        return F.struct(
            n.cast("long").alias("n_words"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct_words"),
            let(hashes, lambda h: repeated_words(h, n)).cast("long").alias("n_repeat_words"),
        )

    def dup_lines(lines: Column) -> Column:
        return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    parts = {
        "word_chars": F.length(text).cast("long") - count(SPACE),
        "n_symbols": count(r"[#*$%&|<>]"),
        "n_dup_lines": let(lines, dup_lines),
        "n_lines": F.size(lines).cast("long"),
        "n_upper": count(r"\p{Lu}"),
        "n_marks": count(r"[!?]"),
    }
    return docs.withColumn("q_words", let(words, stats)).withColumn("q_parts", F.struct(*[c.alias(n) for n, c in parts.items()]))


def features(w: str = "q_words", p: str = "q_parts") -> dict[str, Column]:
    """Each of FEATURES as an expression over text_stats' columns; 0 for texts without words."""
    n, chars, lines = (F.col(x) for x in (f"{w}.n_words", f"{p}.word_chars", f"{p}.n_lines"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return {
        "symbol_ratio": ratio(F.col(f"{p}.n_symbols"), chars),
        "dup_line_ratio": ratio(F.col(f"{p}.n_dup_lines"), lines),
        "repeat_ratio": ratio(F.col(f"{w}.n_repeat_words"), n),
        "distinct_ratio": F.when(n > 0, F.col(f"{w}.n_distinct_words") / n).otherwise(F.lit(1.0)),
        "upper_ratio": ratio(F.col(f"{p}.n_upper"), chars),
        "mark_ratio": ratio(F.col(f"{p}.n_marks"), chars),
        "word_length": ratio(chars, n),
    }


@dataclass(frozen=True)
class Term:
    feature: str
    above: bool
    threshold: float

    def on(self, columns: dict[str, Column]) -> Column:
        x = columns[self.feature]
        return x > self.threshold if self.above else x < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules, each a conjunction of terms: the first that holds rejects a text; none: kept."""

    rules: tuple[tuple[Term, ...], ...]

    def verdict(self, columns: dict[str, Column]) -> Column:
        """The number of the first rule that holds, from 1, or 0, as one CASE expression."""
        out = None
        for i, rule in enumerate(self.rules, 1):
            out = (F if out is None else out).when(conjunction(rule, columns), F.lit(i))
        return F.lit(0) if out is None else out.otherwise(F.lit(0))

    def __str__(self) -> str:
        return "\n".join(f"{i}: reject if {' and '.join(map(str, r))}" for i, r in enumerate(self.rules, 1)) or "keep all"


def conjunction(rule: tuple[Term, ...], columns: dict[str, Column]) -> Column:
    out = F.lit(True)
    for t in rule:
        out = out & t.on(columns)
    return out


def learn(labelled: DataFrame) -> DecisionList:
    """Sequential covering over labelled statistics; labelled: the FEATURES and bad (boolean), at most TRAIN_ROWS rows.

    Half of the rows (by hash of the features) grow rules, the other half prunes them. Growing: the term that raises FOIL's
    gain most is added until no clean row is covered, MOST_TERMS stand or nothing gains; all terms' counts come from
    one aggregation by the values' bins, so the driver sees a few hundred counts. Pruning: last terms go while the
    pruning half's (bad - clean) / (bad + clean) does not fall. A rule with less than LEAST_PRECISION on all rows
    or LEAST_ROWS bad rows ends the list. Each threshold of a rule then moves to the middle between the clean
    rows' nearest value and the MARGIN quantile of the bad rows beyond it. Rows that a rule covers leave both halves.

    Fewer than two labels: an empty list.
    """
    columns = {f: F.col(f) for f in FEATURES}
    rows = written(labelled.select(*FEATURES, "bad", (F.pmod(F.hash(*FEATURES), F.lit(2)) == 0).alias("grows")), "labelled")
    at = [i / (QUANTILES + 1) for i in range(1, QUANTILES + 1)] + [0.001, 0.01, 0.99, 0.999]
    found = rows.groupBy("bad").agg(*[F.percentile_approx(f, at, 10_000).alias(f) for f in FEATURES]).collect()
    if len(found) < 2:
        return DecisionList(())
    cuts = {f: sorted({float(x) for r in found for x in r[f]}) for f in FEATURES}

    def bins(f: str) -> Column:
        # over: cuts below the value; upto: cuts not above it
        array = F.array(*map(F.lit, cuts[f]))
        return F.struct(F.lit(f).alias("f"), F.size(F.filter(array, lambda c: c < F.col(f))).alias("over"), F.size(F.filter(array, lambda c: c <= F.col(f))).alias("upto"))

    rows = written(rows.withColumn("bins", F.array(*map(bins, FEATURES))), "binned")
    rules: list[tuple[Term, ...]] = []
    left = F.lit(True)
    while len(rules) < MOST_RULES:
        rule: tuple[Term, ...] = ()
        while len(rule) < MOST_TERMS:
            here = rows.where(left & F.col("grows") & conjunction(rule, columns)).select("bad", F.explode("bins").alias("b"))
            counts = here.groupBy("bad", "b.f", "b.over", "b.upto").count().collect()
            bad = sum(r["count"] for r in counts if r["f"] == FEATURES[0] and r["bad"])
            clean = sum(r["count"] for r in counts if r["f"] == FEATURES[0] and not r["bad"])
            if not bad or (rule and not clean):
                break
            best, most = None, 1e-9
            for f in FEATURES:
                own = [r for r in counts if r["f"] == f]
                for j, cut in enumerate(cuts[f]):
                    for above in (True, False):
                        held = [r for r in own if (r["over"] > j if above else r["upto"] <= j)]
                        g = gain(sum(r["count"] for r in held if r["bad"]), sum(r["count"] for r in held if not r["bad"]), bad, clean)
                        if g > most:
                            best, most = Term(f, above, cut), g
            if best is None:
                break
            rule = (*rule, best)
        if not rule:
            break
        shorter = [rule[:k] for k in range(1, len(rule) + 1)]
        seen = rows.where(left).agg(*[F.count_if(conjunction(r, columns) & (F.col("bad") == bad) & F.col("grows").isin(halves)) for r in shorter for bad, halves in ((True, [False]), (False, [False]), (True, [True, False]), (False, [True, False]))]).first()
        worth = [(seen[4 * k] - seen[4 * k + 1]) / max(seen[4 * k] + seen[4 * k + 1], 1) for k in range(len(shorter))]
        k = max(range(len(shorter)), key=lambda i: (worth[i], -i))
        bad, clean = seen[4 * k + 2], seen[4 * k + 3]
        if bad < LEAST_ROWS or bad < LEAST_PRECISION * (bad + clean):
            break
        rules.append(with_margins(rows.where(left), shorter[k], columns))
        left = left & ~conjunction(rules[-1], columns)
    return DecisionList(tuple(rules))


def with_margins(rows: DataFrame, rule: tuple[Term, ...], columns: dict[str, Column]) -> tuple[Term, ...]:
    asked = []
    for t in rule:
        x, others = columns[t.feature], conjunction(tuple(o for o in rule if o != t), columns)
        clean, bad = others & ~F.col("bad") & ~t.on(columns), others & F.col("bad") & t.on(columns)
        asked += [(F.max if t.above else F.min)(F.when(clean, x)), F.percentile_approx(F.when(bad, x), MARGIN if t.above else 1 - MARGIN, 10_000)]
    got = rows.agg(*asked).first()
    return tuple(t if got[2 * i] is None or got[2 * i + 1] is None else Term(t.feature, t.above, (got[2 * i] + got[2 * i + 1]) / 2) for i, t in enumerate(rule))


def gain(bad: int, clean: int, all_bad: int, all_clean: int) -> float:
    """FOIL's information gain of a term that leaves bad of all_bad and clean of all_clean rows."""
    import math

    if not bad:
        return 0.0
    return bad * (math.log2(bad / (bad + clean)) - math.log2(all_bad / (all_bad + all_clean)))


def quality_rules(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, rules: DecisionList | None = None) -> DataFrame:
    """docs' columns and q_words, q_parts (statistics), base_failed, rule (number of the rule that rejects, or 0), kept.

    base_failed: n_words < 20, or 100 * n_repeat_words > 30 * n_words. kept: not base_failed, and no rule of the
    list holds. The list is learned from labels (doc_id, quality; 0 is bad), at most train_rows of them, those with the
    smallest hash of doc_id, unless `rules` gives it; rows that base fails are no use to it and left out.

    Null or empty text: no words, so it fails. Null doc_id: judged, never learned from. Null quality: left out.
    Repeated rows: judged alike; labels that repeat a doc_id count once, the lowest. Empty tables: no rows; without labels, base alone decides.
    Other columns stay; the names q_words, q_parts, base_failed, rule and kept are replaced.
    """
    stats = text_stats(docs.drop("q_words", "q_parts", "base_failed", "rule", "kept"))
    failed = (F.col("q_words.n_words") < 20) | (F.col("q_words.n_repeat_words") * 100 > F.col("q_words.n_words") * 30)
    stats = stats.withColumn("base_failed", failed)
    if rules is None:
        marked = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
        taken = written(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows), "marked")
        few = docs.select("doc_id", "text").join(taken, "doc_id")
        # written once: each feature would compute the statistics anew
        few = written(text_stats(few).select("quality", "q_words", "q_parts"), "label-statistics").where(~failed)
        rules = learn(few.select(*[c.alias(f) for f, c in features().items()], (F.col("quality") == 0).alias("bad")))
    return stats.withColumn("rule", rules.verdict(features())).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
