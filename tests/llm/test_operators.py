"""Each operator against a brute-force version on a fixture with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from modq.llm import line_dedup, linking, media, mixing, near_dedup, packing, quality, rules, secret_scan, substring_dedup, token_counts, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHES = ["node", "value", "rank", "row", "size", "bin", "digest", "place", "component", "gone", "label", "shared"]


def make_texts():
    rng = random.Random(3)
    words = ["w%d" % i for i in range(400)] + ["ünï", "the", "of"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage, line = some(120), some(60), some(30)
    texts = [some(rng.randint(5, 200)) for _ in range(25)]
    for k in (1, 2, 3, 9, 30):  # near copies
        t = base.split()
        for _ in range(k):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    texts += [base, base, f"{some(20)} {passage} {some(20)}", f"{some(10)}\n{passage}\n{some(20)}", f"{line}\n{some(15)}\n{line}", f"{some(9)}\n{line} x\n\n{line}"]
    texts += [None, "", "  \n ", "one", "two words", "A b c", "a B C", "<|endoftext|> x <|endoftext|>", "日本語 テキスト 😀", some(6000), "rep rep " * 40, "### $$$ %%% " * 20]
    texts += ['password = "hunter2hunter2" AKIA' + "A" * 16 + " " + "0123456789abcdef" * 2, "token: short1 secret=token : abcdefgh", "key Zx9kLmQ2vB7nRt4pWs8yUe1o here"]
    return texts


TEXTS = make_texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 11 == 0 else f"s{i % 3}", 0) for i, t in enumerate(TEXTS)]
    rows += [rows[3], rows[3], (None, "null id text here", "en", "s1", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASHES:
        df = df.withColumn(c, F.lit(c))
    return df.repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def ids_of(text):
    from tokenizers import Tokenizer

    global _T
    if "_T" not in globals():
        _T = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return _T.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library():
    assert [list(x) for x in tokens.encoder("byte_bpe_50k.json").ids([t or "" for t in TEXTS])] == [ids_of(t) for t in TEXTS]


def test_packing(docs, empty):
    pieces = packing.pack(docs).collect()
    sequences, seen = {}, {}
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4")
        assert len(ids) == p["length"] and zlib.crc32(p["ids"]) == p["ids_crc32"]
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        if p["doc_id"] != 3:
            seen.setdefault(p["doc_id"], {})[p["start"]] = list(ids)
    assert sorted(sequences) == list(range(len(sequences)))
    for s, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 1024 or s == max(sequences)
    for i, t in enumerate(TEXTS):
        if i != 3:
            assert [x for k in sorted(seen[i]) for x in seen[i][k]] == [*ids_of(t), 0]
    assert sum(p["length"] for p in pieces if p["doc_id"] == 3) == 3 * (len(ids_of(TEXTS[3])) + 1)
    assert packing.pack(empty).count() == 0


def test_hilbert_curve_visits_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(512))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_token_counts_and_cache(spark, docs, empty, tmp_path):
    cache = str(tmp_path / "cache")
    got = by_id(token_counts.count_tokens(docs, cache))
    for i, t in enumerate(TEXTS):
        assert (got[i]["n_bytes"], got[i]["n_tokens"]) == (len((t or "").encode()), len(ids_of(t)))
        assert got[i]["over_limit"] == (len(ids_of(t)) > 512)
    stored = token_counts.read_cache(spark, cache, "byte_bpe_50k.json").count()
    assert stored == len({t or "" for t in TEXTS} | {"null id text here"})
    again = token_counts.count_tokens(docs, cache)
    assert again.count() == len(TEXTS) + 3 and spark.read.parquet(cache).count() == stored
    assert token_counts.count_tokens(empty, cache).count() == 0


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(TEXTS) + 3
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = dict(zip(order, [3, 1, 2, 3], strict=True))
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:  # reshare what caps leave over until none is above
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > 2 * sizes[s]]
        for s in over or list(open_):
            target[s] = 2 * sizes[s] if over else weight[s] * level
            left -= target[s]
            open_.discard(s)
    for s in order:
        own = [r for r in rows if r["source"] == s]
        assert all(abs(r["target"] - target[s]) < 1e-6 for r in own)
        assert sum(r["taken"] for r in own) == int(target[s] + 0.5)
        assert all(r["taken"] <= 2 * r["size"] for r in own)
    assert sorted(map(str, mixing.mix(docs.repartition(7)).collect())) == sorted(map(str, rows))
    assert mixing.mix(empty).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got, want = Counter(), Counter()
    for r in mixed.collect():
        got[(r["source"], r["doc_id"])] += len(WORD.findall(r["text"] or ""))
    for r in rows:
        want[(r["source"], r["doc_id"])] += r["taken"]
    assert +got == +want


def test_mixed_rows_without_an_id_and_repeated_rows(spark):
    """Every source's words come out to the word, whatever its rows share."""
    rows = [(None, "s", "a b c d e"), (None, "t", "f g h i j"), (None, "t", "k l m n o"), (None, "t", "p q r s t"), (7, "t", "u v w x y"), (7, "t", "u v w x y"), (7, "t", "u v w x y"), (None, None, "z z z"), (8, "s", None), (9, "s", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    plan = mixing.mix(docs).collect()
    got = Counter()
    for r in mixing.mixed_documents(docs).collect():
        got[r["source"]] += len((r["text"] or "").split())
    want = Counter()
    for r in plan:
        want[r["source"]] += r["taken"]
    assert +got == +want
    assert all(abs(want[r["source"]] - r["target"]) < 1 for r in plan)


def test_substring_dedup(docs, empty):
    first = {}
    words = [WORD.findall(t or "") for t in TEXTS]
    for d, w in enumerate(words):
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    got = by_id(substring_dedup.dedup(docs))
    assert any(r["n_removed"] for r in got.values())
    for d, w in enumerate(words):
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert (got[d]["n_words"], got[d]["n_removed"], got[d]["kept_sha256"], got[d]["kept_text"]) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    assert got[None]["n_removed"] == 0
    assert substring_dedup.dedup(docs).count() == len(TEXTS) + 3
    assert substring_dedup.dedup(empty).count() == 0


def test_substring_dedup_against_history(spark):
    old = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(30)))], "doc_id long, text string")
    new = spark.createDataFrame([(5, "x y " + " ".join(f"a{i}" for i in range(5, 25)))], "doc_id long, text string")
    index = substring_dedup.FingerprintIndex(spark)
    substring_dedup.dedup(old, index)
    got = substring_dedup.dedup(new, index, history=old).collect()
    assert len(got) == 1 and got[0]["n_removed"] == 20 and got[0]["kept_text"] == "x y"
    assert len(index.runs) == 1
    index.drop()


def test_media_round_trip(docs, empty, tmp_path):
    rows = media.media_columns(docs, str(tmp_path))
    got = by_id(rows)
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["width"], r["height"]) == (64, len(payload) // 64) and r["feature"]
        with open(tmp_path / r["shard"], "rb") as f:
            f.seek(r["offset"])
            stored = f.read(r["length"])
        assert hashlib.sha256(stored).hexdigest() == r["media_sha256"] and media.from_png(stored) == payload
    assert rows.count() == len(TEXTS) + 3
    import tarfile

    for shard in {r["shard"] for r in got.values()}:
        with tarfile.open(tmp_path / shard) as t:
            assert all(m.name.endswith(".png") for m in t)
    assert media.media_columns(empty, str(tmp_path / "none")).count() == 0


def test_rules_base_columns(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    judged = rules.quality_rules(docs, labels)
    got = by_id(judged)
    for i, t in enumerate(TEXTS):
        w = WORD.findall(t or "")
        grams = [tuple(w[j : j + 8]) for j in range(len(w) - 7)]
        covered = {x for j, g in enumerate(grams) if grams.count(g) > 1 for x in range(j, j + 8)} if len(w) < 1000 else set()
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r["q_words"]["n_words"], r["q_parts"]["word_chars"], r["q_parts"]["n_symbols"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")))
        assert (r["q_parts"]["n_dup_lines"], r["q_words"]["n_repeat_words"]) == (len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r["base_failed"] and r["kept"])
    assert rules.quality_rules(empty, labels).count() == 0
    assert rules.quality_rules(docs, labels.limit(0)).count() == len(TEXTS) + 3
    assert set(docs.columns) <= set(judged.columns)


def test_rules_learn_thresholds(spark):
    rng = random.Random(1)
    rows = [tuple([rng.random() * (0.1 if f != "mark_ratio" or not bad else 1) + (0.2 if f == "mark_ratio" and bad else 0) for f in rules.FEATURES] + [bool(bad)]) for bad in [0, 0, 0, 1] * 100]
    learned = rules.learn(spark.createDataFrame(rows, ", ".join(f"{f} double" for f in rules.FEATURES) + ", bad boolean"))
    assert learned.rules and learned.rules[0][0].feature == "mark_ratio" and 0.1 < learned.rules[0][0].threshold < 0.25


def test_secrets(docs, empty, spark):
    shaped = docs.select("doc_id", "text", F.col("source").alias("owner"), F.col("lang").alias("repository"))
    got = by_id(secret_scan.with_digests(secret_scan.secrets(shaped)))
    assign = re.compile(secret_scan.ASSIGN.pattern, re.I | re.A)
    for i, t in enumerate(TEXTS):
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t or "") if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t or "") if len(m[0]) >= 32]
        text = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[1] == k for s in spans) for k in range(3)]
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert not text or all(x in got[i]["spans"].split(",") for x in text.split(","))
    assert "live:" in got[len(TEXTS) - 1]["spans"]
    copied = spark.createDataFrame([(i, "key Zx9kLmQ2vB7nRt4pWs8yUe1o here", f"o{i}", "r") for i in range(4)], "doc_id long, text string, owner string, repository string")
    assert all(r["spans"] == "" for r in secret_scan.with_digests(secret_scan.secrets(copied)).collect())
    assert secret_scan.secrets(shaped.limit(0)).count() == 0


def brute_components(sets, linked):
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and linked(sets[a], sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


@pytest.mark.parametrize(("words", "threshold"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, empty, words, threshold):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    sets = {i: shingles(t) for i, t in enumerate(TEXTS)}
    want = brute_components(sets, lambda a, b: 100 * len(a & b) >= threshold * len(a | b))
    assert len(set(want.values())) < len(want)
    rows = near_dedup.near_duplicates(docs, words, threshold)
    got = by_id(rows)
    for i in sets:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), want[i], want[i] == i)
    assert got[None]["kept"] and got[None]["component_id"] is None
    assert rows.count() == len(TEXTS) + 3
    assert near_dedup.near_duplicates(empty, words, threshold).count() == 0


def test_large_near_group_is_linked_whole(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for _ in range(120):
        t = list(base)
        for _ in range(rng.randint(0, 9)):
            t[rng.randrange(150)] = f"c{rng.randrange(40)}"
        texts.append(" ".join(t))
    sets = {i: near_dedup.shingles_of(t, 3, True) for i, t in enumerate(texts)}
    want = brute_components(sets, lambda a, b: 100 * len(a & b) >= 85 * len(a | b))
    got = by_id(near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 85))
    assert {i: got[i]["component_id"] for i in want} == want


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in linking.components(chain).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == got[100] == 100


def test_line_dedup(docs, empty):
    def shingles(x):
        return frozenset(x[s : s + line_dedup.SHINGLE] for s in range(max(1, len(x) - line_dedup.SHINGLE + 1)))

    places = [(d, p, x) for d, t in enumerate(TEXTS) for p, x in enumerate((t or "").split("\n")) if WORD.search(x)]
    lines = sorted({x for _, _, x in places})
    sets = {x: shingles(x) for x in lines}
    component = brute_components(sets, lambda a, b: 100 * len(a & b) >= 80 * len(a | b))
    first, gone = {}, set()
    for d, p, x in places:
        if component[x] in first:
            gone.add((d, p))
        first.setdefault(component[x], (d, p))
    assert gone
    done = line_dedup.dedup_lines(docs)
    assert done.columns == [*docs.columns, "n_lines", "n_removed_lines"]
    got = by_id(done)
    for d, t in enumerate(TEXTS):
        want = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (d, p) not in gone)
        assert got[d]["text"] == want, d
        assert got[d]["n_removed_lines"] == sum(g[0] == d for g in gone)
    assert done.count() == len(TEXTS) + 3
    assert line_dedup.dedup_lines(empty).count() == 0


def test_quality(spark, docs, empty):
    sf = "/root/testdata/sf0.01"
    all_docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality.score(all_docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = [r["predicted"] == r["quality"] for r in scored]
    assert len(right) > 80 and sum(right) / len(right) > 0.95
    rows = quality.score(docs, labels)
    got = rows.collect()
    assert len(got) == len(TEXTS) + 3 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    assert {r["score"] for r in quality.score(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score(empty, labels).count() == 0
