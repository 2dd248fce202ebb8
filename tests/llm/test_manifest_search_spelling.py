"""Merkle manifest, exact top-k search and spelling variants against
brute-force versions, with nulls, ties, repeated rows, long and empty texts,
empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def lower(t):
    return None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


# ------------------------------------------------------------------ manifest

DOCS = ("doc_id long, text string, lang string, source string, n_chars long, g string, "
        "rank int, n int")


def leaf(r, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}"
                     for v in (r[0], r[3], r[2], r[4], text)))


def tree_paths(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
    paths = []
    for i in range(len(nodes)):
        path, k = [], i
        for level in levels[:-1]:
            a = k // 8 * 8
            path.append(("".join(level[a:k]), "".join(level[k + 1:a + 8])))
            k //= 8
        paths.append(path)
    return levels[-1][0], paths


def brute_manifest(rows):
    groups, out, sub = defaultdict(list), Counter(), {}
    for r in rows:
        groups[r[2]].append(r)
    for lang, rs in groups.items():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        sub[lang] = tree_paths([leaf(r, r[1]) for r in rs])
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    root, top = tree_paths([sub[x][0] for x in names])
    for j, lang in enumerate(names):
        for r, path in zip(groups[lang], sub[lang][1]):
            path = path + top[j]
            f = d = leaf(r, r[1])
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                f = leaf(r, lower(r[1]))
            for a, b in path:
                f = h(a + f + b)
            out[r[0], d, sub[lang][0], root, h("".join(a + b for a, b in path)), f, f == root] += 1
    return out


def test_manifest(spark):
    from salescope.llm.merkle_manifest import manifest
    rng = random.Random(1)
    rows = [(rng.choice([None, i, i * 1000003 - 5000, 7, rng.getrandbits(62) - 2 ** 61]),
             rng.choice([None, "", "Ab", "xYz é", f"T{i}", "Q" * 20000]),
             rng.choice([None, "", "en", "en", "en", "de", "é"]),
             rng.choice(["s", None]), rng.choice([1, None]), "x", 1, 2) for i in range(500)]
    rows += [(5, "Same", "en", "s", 1, "x", 1, 2)] * 90 + [(99, "Lone", "zz", None, None, "x", 1, 2)]
    rows += [(None, f"Same id {i}", "en", "s", 1, "x", 1, 2) for i in range(90)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    want = brute_manifest(rows)
    for levels in (1, 3):       # 8 slots a block: several tables; 512: one
        assert Counter(tuple(r) for r in manifest(df, levels).collect()) == want
    assert manifest(df.limit(0)).count() == 0
    one = manifest(spark.createDataFrame([(None,) * 8], DOCS)).collect()
    assert len(one) == 1 and one[0]["verified"] and one[0]["leaf"] == one[0]["root"] == h("-----")


def test_ranks_of_spread_ids(spark):
    """Ids over the whole range of a long: a directory of several tiers."""
    from pyspark.sql import functions as F

    from salescope.llm.merkle_manifest import with_rank
    rng = random.Random(2)
    ids = {rng.getrandbits(63) * rng.choice([1, -1]) for _ in range(300)} \
        | set(range(200)) | {2 ** 63 - 1, -2 ** 63}
    rows = [("a" if i % 3 else "b", i, 1 + (i % 5 == 0)) for i in ids]
    got = with_rank(spark.createDataFrame(rows, "g string, id long, n long"), ["g"],
                    F.col("id"), "r").collect()
    before = Counter()
    for g, i, n in sorted(rows):
        assert [r["r"] for r in got if r["id"] == i] == [before[g]]
        before[g] += n


# --------------------------------------------------------------------- top-k

def brute_top(rows, every=20, k=20):
    known = [(j, i, [math.floor(64 * x) for x in v]) for j, (i, v) in enumerate(rows)
             if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for j, q, v in known:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for n, i, w in known
                          if n != j and len(w) == len(v))
            for r, (s, i) in enumerate(best[:k]):
                out[q, r + 1, i, -s] += 1
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(1)
    rows = [(i, [round(rng.gauss(0, .2), 2) for _ in range(6)]) for i in range(300)]
    rows += [(i % 50, rows[i][1]) for i in range(60)] + [(40, rows[40][1])] * 30
    return rows + [(1000, None), (1020, []), (1040, [None] * 6), (1060, [float("nan")] + [.1] * 5),
                   (None, [.1] * 6), (1080, [float("inf")] * 6), (-20, [0.0] * 6),
                   (2000, [.1] * 3), (2020, [.2] * 3), (2040, [1.0])]


def test_top_k(spark, vectors):
    from salescope.llm.segment_topk import top_k
    rows = [(i, v, "x", 1, 2) for i, v in vectors]
    df = spark.createDataFrame(
        rows, "vec_id long, embedding array<double>, row string, dim int, block int").repartition(3)
    want = brute_top(vectors)
    for bounds in ({}, {"queries_per_block": 3, "part_rows": 50}):
        assert Counter(tuple(r) for r in top_k(df, **bounds).collect()) == want
    assert top_k(df.limit(0)).count() == 0
    huge = spark.createDataFrame([(0, [1e30, -1e30]), (1, [1e30, 1e30]), (2, [1e30, -1e30])],
                                 "vec_id long, embedding array<double>")
    assert [tuple(r) for r in top_k(huge).orderBy("rank").collect()] \
        == [(0, 1, 2, 2 ** 63 - 1), (0, 2, 1, 0)]


def test_bounds_never_exceed_distances():
    import numpy as np

    from salescope.llm.segment_topk import RESOLUTIONS, QueryBlock, features
    rng = np.random.default_rng(3)
    v = np.floor(64 * rng.normal(size=(200, 50)) * rng.integers(1, 4, (200, 1)))
    far = ((v[:, None] - v[None]) ** 2).sum(-1)
    last = np.zeros_like(far)
    for r in RESOLUTIONS:
        f = features(v, r)
        bound = ((f[:, None] - f[None]) ** 2).sum(-1)
        assert (bound <= far + 1e-6).all() and bound.sum() >= last.sum()
        last = bound
    # Bounds do leave candidates out: tight groups far from each other.
    near = np.floor(64 * (rng.normal(size=(1, 50)) + rng.normal(size=(100, 50)) * 0.01))
    block = QueryBlock(np.arange(5), np.arange(5), near[:5], 3)
    block.meet(np.arange(100), np.arange(100), near)
    assert len(block.survivors(-near)) == 0 and len(block.survivors(near)) > 0


# ------------------------------------------------------------------ spelling

def brute_spelling(rows):
    n = Counter()
    for i, t in rows:
        for r in map(lower, re.findall("[A-Za-zÀ-ÿ]+", t or "")):
            x = 1 if i is None else zlib.crc32(f"{i}:{r}".encode())
            n[r if x % 97 else r[:x % len(r)] + r[x % len(r) + 1:]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    cut, near, form = defaultdict(set), defaultdict(set), {}
    for w in n:
        for i in range(len(w)):
            cut[w[:i], w[i + 1:]].add(w)
            if (t := w[:i] + w[i + 1:]) in n:
                near[w].add(t)
                near[t].add(w)
    for same in cut.values():
        for a in same:
            near[a] |= same - {a}
    for w in n:
        if near[w]:
            b = min(near[w], key=lambda t: (-n[t], t))
            if n[b] >= 2 * n[w]:
                form[w] = b
    out = Counter()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None] += 1
    return out


def test_spelling_variants(spark):
    from salescope.llm.spelling_trie import spelling_variants
    rng = random.Random(1)
    base = ["".join(rng.choice("abéÿ×") for _ in range(rng.randint(4, 8))) for _ in range(50)] \
        + ["a" * k for k in range(4, 12)] \
        + ["Hello", "hEllo", "hellooo", "x" * 3000, "x" * 1500 + "y" + "x" * 1499]

    def changed(w):
        i = rng.randrange(len(w))
        return rng.choice([w, w, w[:i] + w[i + 1:], w[:i] + rng.choice("abé") + w[i:],
                           w[:i] + rng.choice("abé") + w[i + 1:]])

    rows = [(rng.choice([None, i]), rng.choice([None, ""]) if i % 50 == 0 else rng.choice(
        " ,.1-").join(changed(rng.choice(base)) for _ in range(60)), "x", 1) for i in range(200)]
    rows += [rows[3]] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, n int").repartition(3)
    assert Counter(tuple(r) for r in spelling_variants(df).collect()) \
        == brute_spelling([r[:2] for r in rows])
    assert spelling_variants(df.limit(0)).count() == 0
    # Every typo's way back: a chain of forms ends in one root.
    chain = spark.createDataFrame([(1, "grand " * 90 + "grands " * 30 + "grandsy " * 10)], "doc_id long, text string")
    out = {r["word"]: r for r in spelling_variants(chain).collect()}
    assert out["grandsy"]["form"] == "grands" and out["grandsy"]["root"] == "grand"


# ------------------------------------------- one row repeated, all rows equal

def test_repeated_row_is_split(spark):
    from salescope.llm.fair_mix import mix_documents, mixed_corpus
    from salescope.llm.kd_shards import shard_documents
    rows = [(i, f"text number {i} " * 9, "en", f"s{i % 3}", 1) for i in range(600)]
    rows += [(5, "the same row " * 9, "en", "s1", 1)] * 400
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, "
                                     "n_chars long").repartition(3)
    total = Counter()
    for r in shard_documents(df).collect():
        total[r["shard"]] += r["size"]
    assert len(total) == 24 and max(total.values()) < 1.3 * sum(total.values()) / 24
    mixed = mix_documents(df).collect()
    assert sorted(map(tuple, mixed)) == sorted(map(tuple, mix_documents(df.repartition(7)).collect()))
    assert len(mixed) == len(rows)
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in mixed)
    out = mixed_corpus(df.unionByName(df.limit(1).selectExpr(
        "doc_id", "cast(null AS string) text", "lang", "source", "n_chars"))).collect()
    assert None not in {r["text"] for r in out}
    same = spark.createDataFrame([rows[-1]] * 50, df.schema)
    shards = shard_documents(same, n_shards=4).collect()
    assert len(shards) == 50 and len({(r["shard"], r["slot"]) for r in shards}) == 50
    assert sum(r["taken"] for r in mix_documents(same).collect()) == pytest.approx(1.5 * 50 * 27, abs=27)
