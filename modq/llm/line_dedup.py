"""Fuzzy line dedup by MinHash, DataFrame functions only."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modq.llm.linking import link, matching, print_filter, prints
from modq.session import release, short_methods, written

#: Characters of a shingle. One begins at every character of a line; a shorter line is one shingle.
SHINGLE = 5
#: Shingles whose hashes one row makes, as one expression each.
STEP = 32
#: A band is the ROWS next hashes from one of BANDS points on the circle of hashes. A pair of similarity s, at 0.8 or more, has
#: equal ones in some band with a chance of about 1 - (1 - s**ROWS)**BANDS, 0.994 at 0.8 and over 0.9999 from 0.9.
#: Unlike lines of one language are at 0.02 to 0.1, so shorter bands would let most lines meet.
BANDS, ROWS = 17, 6
#: (n, bands, rows): bands of sets of n hashes or more, up to those that may link to sets below the next one's n. Long lines of one language are
#: alike at random, the longer they are (0.08 from 400 hashes on, 0.15 from 800) and the more lines the more of them; so where hashes suffice, bands
#: are longer, and so many that the chance to meet is as above.
TIERS = ((0, BANDS, ROWS), (154, 22, 7), (400, 28, 8), (800, 57, 11))
#: A small set's bands overlap, so that it also has those of further orders: sets below BELOW[i] hashes have order i + 1. The
#: smallest have shorter bands too: six hashes are most of such a set.
BELOW, SHORT_ROWS = (100, 16, 16), 3
#: Lists of so many lines or fewer are compared pair by pair.
COMPARED = 32
#: Words of 64 bits of a set's parity bitmap, by which most pairs that are no link are left before their texts are gathered.
WORDS = 16
#: Parts of the bands. A value stands in one of them alone, so that lines meet in one part after the other and no more than a part's values are in a shuffle.
PARTS = 4
#: Looks ahead for a shingle and then takes one character, so that each match begins at the next character.
SHINGLES = rf"(?s)(?=(.{{{SHINGLE}}}))."
HAS_WORD = r"[^\x20\x09-\x0D]"


def shingles(line: Column) -> Column:
    """The character shingles of a line, in order and as often as they are there."""
    return F.when(F.length(line) < SHINGLE, F.array(line)).otherwise(F.regexp_extract_all(line, F.lit(SHINGLES), F.lit(1)))


def hashed_sets(lines: DataFrame, *keys: str) -> DataFrame:
    """keys, hashes: the distinct hashes of each line's (keys, line) shingles, ascending.

    Characters of four bytes each make a shingle's place known without a walk through the line. A line's
    pieces of STEP shingles are hashed by plain expressions, which run as compiled code, unlike a lambda's. Rows
    that are dealt by keys stay where they are: hashes take many times a line's room.
    """
    width = 4 * SHINGLE
    wide = lines.select(*keys, F.encode("line", "UTF-32").alias("b"))
    wide = wide.withColumn("n", F.greatest(F.lit(1), F.floor(F.length("b") / 4).cast("int") - (SHINGLE - 1)))
    starts = wide.select(*keys, "b", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(STEP))).alias("start"))
    pieces = starts.select(*keys, F.substring("b", F.col("start") * 4 + 1, F.lit(4 * STEP + width)).alias("piece"), F.least(F.lit(STEP), F.col("n") - F.col("start")).alias("m"))
    # a piece with fewer shingles repeats its last one
    hashes = [F.xxhash64(F.substring("piece", F.least(F.lit(i), F.col("m") - 1) * 4 + 1, F.lit(width))) for i in range(STEP)]
    whole = pieces.select(*keys, F.array(*hashes).alias("part")).groupBy(*keys).agg(F.collect_list("part").alias("parts"))
    return whole.select(*keys, F.array_distinct(F.flatten("parts")).alias("x")).select(*keys, F.sort_array("x").alias("hashes"))


def points(bands: int) -> list[Column]:
    """The points on the circle of hashes from which bands begin."""
    return [F.lit((b * (1 << 64)) // bands - (1 << 63)) for b in range(bands)]


def marked(values: Column, bands: int) -> Column:
    """values (ascending) and where the points would stand among them."""
    return F.sort_array(F.concat(values, F.array(*points(bands))))


def parted(circle: Column, marks: Column, bands: int, rows: int, order: int) -> list[Column]:
    """PARTS arrays of about as many bands each, one value per band, null where there are no marks; circle: a set's values and at least the rows first ones again."""
    first = [(F.array_position(marks, p) - b).cast("int") for b, p in enumerate(points(bands))]
    made = [F.xxhash64(F.lit((rows * (len(BELOW) + 1) + order) * 64 + b), F.slice(circle, at, rows)) for b, at in enumerate(first)]
    return [F.when(marks.isNotNull(), F.array(*made[i::PARTS])) for i in range(PARTS)]


def parted_signatures(sets: DataFrame, threshold: int = 80) -> DataFrame:
    """h, g, n (distinct shingles), part0, ... (values of PARTS parts of the bands): one row per set (h, g, hashes).

    The rows least values from a point on are a MinHash of so many values under the order that begins at that point. A small
    set's bands share values, so that it also has those of further orders, each a rehash of the set. Two sets at the threshold have
    a tier of bands in common: the larger has no more than 100 / threshold times the smaller's hashes.
    """
    n = F.size("hashes").cast("long")
    most = [n * threshold <= (after[0] - 1) * 100 for after in TIERS[1:]] + [F.lit(True)]
    marks = [F.when((n >= least) & m, marked(F.col("hashes"), bands)).alias(f"marks{i}") for i, ((least, bands, _), m) in enumerate(zip(TIERS, most, strict=True))]
    circle = F.concat("hashes", F.slice("hashes", 1, max(rows for _, _, rows in TIERS)))
    # large sets are laid out once; what small ones have besides is made without their hashes in the row
    sets = sets.select("h", "g", n.alias("n"), F.when(n < max(BELOW), F.col("hashes")).alias("hashes"), circle.alias("circle"), *marks)
    tiers = [[c.alias(f"tier{i}_{p}") for p, c in enumerate(parted(F.col("circle"), F.col(f"marks{i}"), bands, rows, 0))] for i, (_, bands, rows) in enumerate(TIERS)]
    names = [f"tier{i}" for i in range(len(TIERS))]
    sets = sets.select("h", "g", "n", "hashes", *sum(tiers, []))
    rehash = lambda order: F.sort_array(F.transform("hashes", lambda x: F.xxhash64(F.lit(order), x)))
    for order in range(len(BELOW) + 1):
        wanted = [(below, rows) for below, rows in ((BELOW[order - 1] if order else 0, ROWS), (BELOW[-1], SHORT_ROWS)) if below]
        laid = sets.withColumn("own", F.when(F.col("n") < max(below for below, _ in wanted), rehash(order)))
        laid = laid.select("*", F.concat("own", F.slice("own", 1, ROWS)).alias("circle"), marked(F.col("own"), BANDS).alias("marks"))
        for below, rows in wanted:
            here = F.when(F.col("n") < below, F.col("marks"))
            names.append(f"order{order}_{rows}")
            laid = laid.withColumns({f"order{order}_{rows}_{p}": c for p, c in enumerate(parted(F.col("circle"), here, BANDS, rows, order))})
        sets = laid.drop("own", "circle", "marks")
    return sets.select("h", "g", "n", *[F.flatten(F.array_compact(F.array(*[f"{name}_{i}" for name in names]))).alias(f"part{i}") for i in range(PARTS)])


def signatures(sets: DataFrame, threshold: int = 80) -> DataFrame:
    """h, g, n, bands: parted_signatures() with the parts in one array."""
    return parted_signatures(sets, threshold).select("h", "g", "n", F.concat(*[f"part{i}" for i in range(PARTS)]).alias("bands"))


def shared_values(members: DataFrame, part: str) -> DataFrame:
    """value, node, n, lines (how many share the value) for the values of a part (of members: node, n, parts) that several lines share."""
    values = members.select("node", "n", F.explode(part).alias("value"))
    many = written(values.groupBy("value").agg(F.count("*").alias("lines")).where("lines > 1"), "shared")
    out = written(matching(values, many, ["value"]), "postings")
    release(many)
    return out


def document_key() -> list[Column]:
    """doc_id, text_key: rows with one id and one text are one document; rows without an id are told apart by their texts."""
    return [F.col("doc_id"), F.xxhash64("text").alias("text_key")]


def line_ids(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, pos, h, g, line for every \\n-split line with a word; h, g: 128 bits of its text."""
    lines = docs.select(*document_key(), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).where(F.col("line").rlike(HAS_WORD))
    return lines.select("doc_id", "text_key", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), "line")


def line_components(docs: DataFrame, threshold: int = 80) -> DataFrame:
    """h, g, ch, cg: the lines that fuzzy links join to others, and the line that names their component."""
    ids = line_ids(docs)
    # a line's signature is made where its one text is: texts are shuffled, signatures are not
    lines = ids.groupBy("h", "g").agg(F.min("line").alias("line"))
    members = written(parted_signatures(hashed_sets(lines, "h", "g"), threshold).withColumn("node", F.monotonically_increasing_id()), "bands")
    parts = [shared_values(members, f"part{i}") for i in range(PARTS)]
    postings = functools.reduce(DataFrame.unionByName, parts)
    ranks = postings.groupBy("node").agg((-F.sum("lines")).alias("rank"))
    lists = written(postings.select("value", "node", "n").join(ranks, "node"), "lists")
    # a set takes many times its line's room, so that lines travel and sets are made where they are compared
    wanted = written(members.select("h", "g", "node", "n").join(ranks.select("node"), "node", "left_semi"), "wanted")
    release(members, *parts)
    texts = written(matching(ids.select("h", "g", "line"), wanted, ["h", "g"]).groupBy("node").agg(F.min("n").alias("n"), F.min("line").alias("line")), "texts")
    # dealt by node before they are hashed
    placed = texts.select("node", "line").repartition("node")
    bitmaps = written(prints(hashed_sets(placed, "node").select("node", F.explode("hashes").alias("value")), WORDS), "bitmaps")
    likely = print_filter(bitmaps, threshold, WORDS)

    def verify(pairs: DataFrame) -> DataFrame:
        left = likely(pairs).join(texts.select(F.col("node").alias("a"), F.col("line").alias("la"), F.col("n").alias("na")), "a")
        both = left.join(texts.select(F.col("node").alias("b"), F.col("line").alias("lb"), F.col("n").alias("nb")), "b")
        common = F.size(F.array_intersect(shingles(F.col("la")), shingles(F.col("lb"))))
        return both.where(common * (100 + threshold) >= (F.col("na") + F.col("nb")) * threshold).select("a", "b")

    def whole_sets(nodes: DataFrame) -> DataFrame:
        return hashed_sets(texts.select("node", "line").join(nodes, "node", "left_semi"), "node").select("node", F.explode("hashes").alias("value"))

    linked = link(lists, verify, whole_sets, threshold, COMPARED, bitmaps)
    named = wanted.select("node", "h", "g").join(linked, "node")
    heads = wanted.select(F.col("node").alias("component"), F.col("h").alias("ch"), F.col("g").alias("cg"))
    out = written(named.join(heads, "component").select("h", "g", "ch", "cg"), "line-components")
    release(lists, bitmaps, texts, wanted)
    return out


def line_verdicts(docs: DataFrame, threshold: int = 80) -> DataFrame:
    """doc_id, text_key, pos of the occurrences that go: all but the first (by doc_id, nulls last, text_key, pos) of each component."""
    linked = line_components(docs, threshold)
    # most lines are a component of their own: two longs name it, or those of the line that stands for it
    named = matching(line_ids(docs).select("doc_id", "text_key", "pos", "h", "g"), linked, ["h", "g"], "left")
    at = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "pos")
    named = written(named.select(F.coalesce("ch", "h").alias("ch"), F.coalesce("cg", "g").alias("cg"), at.alias("at")), "named")
    # each task sums its own rows first; then one join of written tables, whose large groups Spark can split
    first = named.groupBy("ch", "cg").agg(F.count("*").alias("n"), F.min("at").alias("first")).where("n > 1")
    first = written(first, "first")
    return named.join(first, ["ch", "cg"]).where("not (at <=> first)").select("at.doc_id", "at.text_key", "at.pos")


def dedup_lines(docs: DataFrame, threshold: int = 80) -> DataFrame:
    """docs' columns with the text rid of repeated lines, and n_lines, n_removed_lines.

    Lines are \\n-split; those without a word are no candidates and stay. Two lines are linked when the Jaccard
    similarity of their character shingle sets is threshold percent or more, or their texts are equal; of
    each component one line stays, the first by (doc_id, line number). Candidates come from MinHash bands, those that their sets'
    sketches show to be far apart are left, every link is checked on the sets, components come from distributed union-find.

    Null text: stays null, no lines. Empty text: as it is, no lines with a word. Rows with the same doc_id and text are one
    document and lose the same lines in each copy; rows of one doc_id with other texts are documents of their own,
    in the order of a hash. So are rows of null doc_id: each counts as after all others, and rows with one text as one
    document. Empty table: no rows. Other columns stay; n_lines and n_removed_lines are replaced.
    """
    docs = docs.drop("n_lines", "n_removed_lines")
    with short_methods(docs.sparkSession):
        verdicts = line_verdicts(docs.select("doc_id", "text"), threshold)
    gone = verdicts.groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("gone"))
    # a row travels as one struct, so that no name of its columns meets one of these
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("d"), *[c.alias(n) for c, n in zip(document_key(), ("own_doc", "own_key"), strict=True)])
    rows = packed.join(gone, F.col("own_doc").eqNullSafe(F.col("doc_id")) & (F.col("own_key") == F.col("text_key")), "left")
    text, lines = F.col("d.text"), F.split("d.text", "\n", -1)
    marks = F.map_from_arrays(F.col("gone"), F.transform("gone", lambda x: F.lit(True)))
    kept = F.transform(F.array(marks), lambda m: F.array_join(F.filter(lines, lambda x, i: ~F.coalesce(F.try_element_at(m, i), F.lit(False))), "\n"))[0]
    n_lines = F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.filter(lines, lambda x: x.rlike(HAS_WORD)))).cast("long")
    n_removed = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long")
    whole = F.col("d").withField("text", F.when(F.col("gone").isNull(), text).otherwise(kept))
    return rows.select(whole.alias("d"), n_lines.alias("n_lines"), n_removed.alias("n_removed_lines")).select("d.*", "n_lines", "n_removed_lines")
