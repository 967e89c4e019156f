"""Exact dedup, whitening and the Merkle manifest against plain versions, odd rows included."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from modq.llm import exact_dedup, merkle, secret_scan, whitening
from modq.session import fresh_path

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
ODD = [(None, "a", None, 1, None)] * 3 + [(1, None, "en", None, "ABC")] * 12 + [(i, "s", "zz", i, "Xy") for i in range(70)]
ODD += [(5, "s", "é", 1, ""), (6, "s", "É", 1, "É"), (7, "s", "É", 1, "é"), (8, "", "", 0, "long " * 50_000), (None, "a", "zz", 1, "xY")]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_groups(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[(t or "").translate(LOW)].append(d)
    out = []
    for t, ids in groups.items():
        keep = max((d for d in ids if d is not None), default=None)
        for d, n in Counter(ids).items():
            out += [(d, keep, len(ids), d == keep and i == 0, sha(t)) for i in range(n)]
    return sorted(out, key=str)


def ids_and_texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("settings", [{}, {"capacity": 16}, {"bits": 3, "capacity": 4}])
def test_exact_duplicates(spark, settings):
    """Buckets that are split, and hashes so short that different texts are chained, change nothing."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(ODD, SCHEMA)
    for docs in (table, odd, odd.limit(0), odd.select("doc_id", "text", *[F.lit(7).alias(c) for c in ("h", "t", "n", "bucket", "slot", "keep_id")])):
        got = exact_dedup.exact_duplicates(docs, **settings)
        assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == plain_groups(ids_and_texts(docs))


def test_index(spark):
    """Every bucket holds no more keys than it may, is one range of slots, and its texts are in it alone."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = fresh_path(spark, "index")
    exact_dedup.build(docs, path, capacity=8)
    slots = [tuple(r) for r in spark.read.parquet(f"{path}/directory").select("slot", "bucket", "depth").collect()]
    deepest = max(d for _, _, d in slots)
    assert sorted(s for s, _, _ in slots) == list(range(1 << deepest, 2 << deepest))
    assert all(s >> (deepest - d) == b for s, b, d in slots)
    entries = exact_dedup.read_entries(spark, path).collect()
    held = Counter(e["bucket"] for e in entries)
    assert max(held.values()) <= 8
    depth = {b: d for _, b, d in slots}
    assert all(e["bucket"] == ((e["h"] & (1 << 64) - 1) >> (64 - depth[e["bucket"]])) | 1 << depth[e["bucket"]] for e in entries)
    # a bucket that is not the root has a sibling, and with it more keys than one may hold
    for b in held:
        if b > 1:
            below = sum(n for c, n in held.items() if c >> (max(0, c.bit_length() - (b >> 1).bit_length())) == b >> 1)
            assert below > 8


def plain_manifest(rows):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return sha("".join(map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text))))

    def build(digests):
        paths, at, nodes = [[] for _ in digests], list(range(len(digests))), list(digests)
        while len(nodes) > 1:
            for i, path in enumerate(paths):
                a, run = at[i], at[i] // 8 * 8
                path.append(("".join(nodes[run:a]), "".join(nodes[a + 1 : run + 8])))
                at[i] = a // 8
            nodes = [sha("".join(nodes[j : j + 8])) for j in range(0, len(nodes), 8)]
        return paths, nodes[0]

    groups, out = defaultdict(list), []
    for r in rows:
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r["doc_id"], leaf(r, r["text"] and r["text"].translate(LOW))))
    built = {}
    for g, leaves in groups.items():
        leaves.sort(key=lambda x: x[:3])
        built[g] = build([x[2] for x in leaves])
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops, root = build([built[g][1] for g in order]) if order else ([], None)
    for g, leaves in groups.items():
        for x, path in zip(leaves, built[g][0], strict=True):
            path = path + tops[order.index(g)]
            node = x[4] if x[3] is not None and zlib.crc32(str(x[3]).encode()) % 3 == 0 else x[2]
            for before, after in path:
                node = sha(before + node + after)
            out.append((x[3], x[2], built[g][1], root, sha("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=str)


def test_manifest(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 16)  # several windows a language
    table = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(ODD, SCHEMA)
    clashing = odd.select("*", *[F.lit("x").alias(c) for c in ("place", "n", "digest", "path", "before", "part", "g", "of")])
    for docs in (table, odd, clashing, odd.limit(0), odd.where("doc_id = 8")):
        got = sorted((tuple(r) for r in merkle.checked(merkle.manifest(docs)).collect()), key=str)
        assert got == plain_manifest([r.asDict() for r in docs.collect()])


def plain_whitening(rows, components=16):
    """{id: deviations}, {(id, component): |whitened|}, explained, n of rows (id, vector)."""
    x = [(k, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(v) for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[n * a - s for a, s in zip(v, sums, strict=True)] for v in fit], object)
    d = len(sums)
    v = np.array([[int((centred[:, i] * centred[:, j]).sum()) / n**3 for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    deviations, whitened = defaultdict(set), {}
    for k, row in x:
        y = [n * a - s for a, s in zip(row, sums, strict=True)]
        deviations[k].add(sum(c * c for c in y))
        for i, w in enumerate((np.array(y, float) / n) @ vectors / np.sqrt(values), 1):
            whitened[k, i] = abs(w)
    return deviations, whitened, values / np.trace(v), n


def test_whiten(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    deviations, whitened, explained, n = plain_whitening(rows)
    got = whitening.whiten(df).collect()
    assert len(got) == 16 * len(rows)
    for r in got:
        assert r["n"] == n and r["deviation"] in deviations[r["vec_id"]]
        assert abs(abs(r["whitened"]) - whitened[r["vec_id"], r["component"]]) < 1e-6
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9 and r["identity_error"] < 1e-6
    # one sign for all rows: the covariance of the whitened columns is the identity
    by_id = defaultdict(dict)
    for r in got:
        by_id[r["vec_id"]][r["component"]] = r["whitened"]
    vectors = {tuple(v): k for k, v in rows}
    w = np.array([[by_id[k][c] for c in range(1, 17)] for k in vectors.values()])
    if len(vectors) == n:
        assert np.abs(w.T @ w / n - np.eye(16)).max() < 1e-6


def test_whiten_odd(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 5), i * 0.25, 1e3 if i == 3 else -float(i * i)]) for i in range(9)]
    bad = [(90, None), (91, [1.0, None, 2.0]), (92, [nan, 1.0, 2.0]), (93, [inf, 1.0, 2.0]), (94, []), (95, [1.0])]
    rows = good + [(None, [2.0, 3.0, 4.0]), good[0], (50, good[0][1])] + bad
    df = spark.createDataFrame([(k, v, 1, 2) for k, v in rows], "vec_id long, embedding array<double>, key int, x int")
    sound = [r for r in rows if r not in bad]
    deviations, whitened, explained, n = plain_whitening([(-1 if k is None else k, v) for k, v in sound])
    got = whitening.whiten(df).collect()
    assert len(got) == 3 * len(sound) and n == 10
    for r in got:
        k = -1 if r["vec_id"] is None else r["vec_id"]
        assert r["deviation"] in deviations[k] and abs(abs(r["whitened"]) - whitened[k, r["component"]]) < 1e-6
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9 and r["identity_error"] < 1e-6
    assert whitening.whiten(df.limit(0)).collect() == [] and whitening.whiten(df.where("vec_id = 0")).collect() == []
    # beyond a long there is no deviation; entries far beyond 2**52 count as that
    far = whitening.whiten(spark.createDataFrame([(i, [1e30 if i == 3 else float(i)]) for i in range(6)], "vec_id long, embedding array<double>"))
    assert {(r["vec_id"], r["deviation"]) for r in far.collect()} == {(i, None) for i in range(6)}
    # a constant dimension has no component
    flat = spark.createDataFrame([(i, [float(i), 7.0]) for i in range(6)], "vec_id long, embedding array<float>")
    assert {r["component"] for r in whitening.whiten(flat).collect()} == {1}


def test_scatter_is_exact():
    rng = np.random.default_rng(5)
    for spread in (1, 300, 1 << 40):
        x = rng.integers(-spread, spread + 1, (130, 5)) + whitening.BASE
        products, sums = whitening.scatter(x)
        y = (x - whitening.BASE).astype(object)
        assert sums == y.sum(axis=0).tolist()
        assert all(products[i][j] == int((y[:, i] * y[:, j]).sum()) for i in range(5) for j in range(i, 5))


def test_ownership_of_every_span(spark):
    """Owners, repositories and occurrences of each span's credential in the corpus, null ones too, and the verdict by them, against plain counts."""
    from modq.llm import queries

    given = [r.asDict() for r in queries.QUERIES["op8_secrets"](spark, SF).collect()]
    docs = [(r["doc_id"], r["text"], r["source"], f"{r['source']}/{r['lang']}") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    live, wide, few = "Zx9kLmQ2vB7nRt4pWs8yUe1o", "password = 'Hunter2Hunter2'", "0123456789abcdef" * 2
    odd = [(i, f"key {live} and {few}", "own", "r1") for i in range(3)] + [(9, wide, None, None), (10, wide, None, "r1"), (11, f"{wide} {wide}", "b", None), (12, f"{live}x {few}", None, None), (None, few, "own", "r2"), (13, None, "a", "r")]
    odd += [(20 + i, "AKIA" + "B" * 16, "own", f"r{i}") for i in range(4)]
    found = secret_scan.with_digests(secret_scan.secrets(spark.createDataFrame(odd, "doc_id long, text string, owner string, repository string"))).collect()
    for rows, got in ((docs, given), (odd, [r.asDict() for r in found])):
        owners, places, occurrences = defaultdict(set), defaultdict(set), Counter()
        spans = []
        for d, text, owner, repository in rows:
            base = secret_scan.base_spans(text or "")
            every = base + secret_scan.candidates(text or "", base)
            for _, _, _, value in every:
                owners[value].add(owner)
                places[value].add((owner, repository))
                occurrences[value] += 1
            spans.append((d, every))
        want = []
        for d, every in spans:
            told = []
            for kind, start, end, value in sorted(every, key=lambda s: (s[1], s[0])):
                copied = len(owners[value]) > secret_scan.MOST_OWNERS or len(places[value]) > secret_scan.MOST_REPOSITORIES
                if kind < 3 or not copied:
                    told.append((secret_scan.KINDS[kind], start, end, len(owners[value]), len(places[value]), occurrences[value], "example" if copied else "live"))
            want.append((d, told, sum(t[-1] == "live" for t in told), sum(t[-1] == "example" for t in told), max((t[3] for t in told), default=0)))
        assert sorted(((r["doc_id"], [tuple(o) for o in r["owners"]], r["n_live"], r["n_example"], r["most_owners"]) for r in got), key=str) == sorted(want, key=str)
    assert any(r["n_example"] for r in found if r["doc_id"] == 20)
