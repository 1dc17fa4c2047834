"""Periodic runs, greatest inner products and ranked lexical search against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from rankspark.llm import inner_top, lexical, periodic, queries

# --- periodic runs -----------------------------------------------------------------------


def brute_runs(w):
    out = set()
    for q in range(1, len(w) // 4 + 1):
        equal, i = [w[j] == w[j + q] for j in range(len(w) - q)], 0
        while i < len(equal):
            if not equal[i]:
                i += 1
                continue
            k = i
            while k < len(equal) and equal[k]:
                k += 1
            smallest = next(p for p in range(1, q + 1) if all(w[x] == w[x + p] for x in range(i, k + q - p)))
            if smallest == q and k + q - i >= max(6, 4 * q):
                out.add((i, k + q - i, q))
            i = k
    return sorted(out)


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        n, letters = rng.randint(0, 70), rng.choice([1, 2, 3, 5])
        w = [rng.randrange(letters) for _ in range(n)]
        if n and rng.random() < 0.5:
            p, s = rng.randint(1, max(1, n // 4)), rng.randrange(n)
            w = [w[i] if i < s else w[s + (i - s) % p] for i in range(n)]
        assert periodic.find_runs(np.array(w, np.int32)) == brute_runs(w), w


def test_z_function():
    rng = random.Random(2)
    for _ in range(200):
        s = np.array([rng.randrange(2) for _ in range(rng.randint(1, 40))])
        z = periodic.z_function(s, len(s))
        assert all(z[i] == next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(1, len(s)))


def test_a_long_text_of_one_word_and_a_long_period():
    assert periodic.find_runs(np.zeros(200_000, np.int32)) == [(0, 200_000, 1)]
    w = np.resize(np.arange(30_000), 130_000)
    assert periodic.find_runs(w) == [(0, 130_000, 30_000)]
    assert periodic.find_runs(np.arange(200_000)) == []


def digest_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    """Texts of the fixture and some that repeat, as the driver's tables lie."""
    rng = random.Random(9)
    at = tmp_path_factory.mktemp("tables")
    rows = [(300 + i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(400, "x " * 50), (401, "a b c " * 9 + "d " * 7), (402, "x y " * 8), (403, "A a " * 4)]
    from pyspark.sql import functions as F

    short = docs.where("length(text) < 2000 or text is null")
    short.unionByName(spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)), allowMissingColumns=True).write.parquet(f"file://{at}/documents.parquet")
    items = [(1, "The water garden, WINDOW river"), (2, "haus; garten - stein"), (3, "É à fenêtre 12345"), (4, None), (5, "..."), (1, "letter"), (6, "absent"), (7, "the " * 30 + "of and"), (None, "leute")]
    spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x")).write.parquet(f"file://{at}/benchmark.parquet")
    return f"file://{at}"


def test_op11_equals_brute_force(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op11_periodic_runs(spark, folder)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    expected = collections.Counter(digest_row(*r) for r in rows)
    assert sum(r[1] > 0 for r in expected) > 30
    assert collections.Counter(tuple(r) for r in got.collect()) == expected


def test_collapse_of_awkward_rows(spark):
    from pyspark.sql import functions as F

    rows = [(1, None), (1, None), (2, ""), (3, " \t\n"), (None, "a " * 6), (4, "a " * 5), (5, "x y " * 4 + "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit(1))
    got = collections.Counter((r.id, tuple(tuple(x) for x in r.runs), r.collapsed) for r in periodic.collapse(df).collect())
    assert got == collections.Counter({(1, (), ""): 2, (2, (), ""): 1, (3, (), ""): 1, (None, ((0, 6, 1),), "a"): 1, (4, (), "a a a a a"): 1, (5, ((0, 9, 2),), "x y"): 1})
    assert periodic.collapse(df.where("false")).count() == 0


# --- greatest inner products ------------------------------------------------------------------


def brute_products(rows, asked, k):
    out = []
    for q, v in sorted(set(asked)):
        scores = sorted((-min(max(sum(a * b for a, b in zip(v, x)), -(2**63)), 2**63 - 1), i) for i, x in rows if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("shape", ["plain", "spread", "huge", "zero"])
def test_products_equal_brute_force(spark, shape):
    rng = np.random.default_rng(4)
    x = rng.integers(-40, 40, (400, 8)) * (np.array([9, 5, 1, 1, 1, 1, 1, 1]))
    if shape == "spread":
        x = x * (10 ** rng.integers(0, 5, (400, 1)))
    if shape == "huge":
        x = x * (10 ** rng.integers(0, 16, (400, 1)))
    if shape == "zero":
        x[::3] = 0
    rows = [(i, tuple(v)) for i, v in enumerate(x.tolist())] + [(7, tuple(x[8].tolist())), (9, tuple(x[9].tolist()))] + [(1000 + i, tuple(x[5].tolist())) for i in range(30)]
    df = spark.createDataFrame([(i, list(v)) for i, v in rows], "vec_id long, v array<bigint>").repartition(3)
    got = inner_top.top_products(df, df.where("vec_id % 20 in (0, 7)"), 5, block=64)
    assert sorted(tuple(r) for r in got.collect()) == brute_products(rows, [r for r in rows if r[0] % 20 in (0, 7)], 5)


def test_many_blocks_of_queries_meet_in_a_join(spark, monkeypatch):
    monkeypatch.setattr(inner_top, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(inner_top, "QUERY_BLOCK", 16)
    x = np.random.default_rng(5).integers(-40, 40, (300, 6)).tolist()
    rows = [(i, tuple(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, list(v)) for i, v in rows], "vec_id long, v array<bigint>")
    got = inner_top.top_products(df, df.where("vec_id % 4 = 0"), 3, block=32)
    assert sorted(tuple(r) for r in got.collect()) == brute_products(rows, [r for r in rows if r[0] % 4 == 0], 3)


def test_bounds_leave_out_most_pairs():
    """Vectors that lie near a plane, of very different lengths: few need an exact score."""
    rng = np.random.default_rng(6)
    x = np.rint(rng.normal(size=(4096, 32)) * np.array([900.0] * 2 + [20.0] * 30) * rng.pareto(1.5, (4096, 1))).astype(np.int64)
    turn = np.linalg.eigh(x.T.astype(float) @ x)[1][:, ::-1]
    length = np.linalg.norm(x, axis=1)
    by = np.argsort(-length)
    block = lambda i: {"ids": i, "x": x[i], "turned": x[i] @ turn, "length": length[i], "rest": np.stack([np.linalg.norm((x[i] @ turn)[:, f:], axis=1) for f in (2, 6)], axis=1)}
    q, best = block(np.arange(64)), inner_top.Best(64, 5)
    assert inner_top.search(q, block(by), best, [2, 6]) < 0.3 * 64 * 4096
    exact = x[:64] @ x.T
    exact[np.arange(64), np.arange(64)] = -(1 << 62)
    assert (np.sort(exact, axis=1)[:, ::-1][:, :5] == best.scores).all()


def test_quantised_and_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -0.001]), (1, None), (2, []), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [0.0, 0.0]), (7, [0.5, 0.25]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (0, [1.0, -0.001])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    at = df.select("vec_id", inner_top.quantised(df.embedding).alias("v"))
    assert [r.v for r in at.where("vec_id = 0").collect()] == [[256, -1]] * 2
    got = inner_top.top_products(at, at.where("vec_id = 0 or vec_id = 6"), 5)
    assert sorted(tuple(r) for r in got.collect()) == [(0, 1, 7, 256 * 128 - 64), (0, 2, 6, 0), (6, 1, 0, 0), (6, 2, 0, 0), (6, 3, 7, 0)]
    assert inner_top.top_products(at.where("false"), at, 5).count() == 0
    assert inner_top.top_products(at, at.where("false"), 5).count() == 0


# --- ranked lexical search ----------------------------------------------------------------------


def brute_ranking(docs, items, k=50):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    split = lambda t: pattern.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    own = [(i, collections.Counter(split(t))) for i, t in docs if split(t)]
    n_docs, total = len(own), sum(sum(c.values()) for _, c in own)
    df = collections.Counter(t for _, c in own for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(split(t))
    out = []
    for item, ts in asked.items():
        scored = []
        for i, c in own:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return out


def same(got, expected):
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, expected))


def test_op13_equals_brute_force(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    got = queries.op13_lexical_search(spark, folder)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    same(got.collect(), brute_ranking(docs, items))


def test_groups_windows_and_handed_on_blocks(spark, folder, monkeypatch):
    """Many groups of items, windows of 64 ids and blocks of few postings change nothing."""
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    monkeypatch.setattr(lexical, "WINDOW", 64)
    monkeypatch.setattr(lexical, "HELD_POSTINGS", 20)
    same(lexical.ranked(docs, items, 7, group_terms=4).collect(), brute_ranking([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()], 7))


def test_buckets_are_empty_after_a_harvest():
    at = lexical.Buckets()
    at.add(np.array([0, 63, 64, 65535]), np.array([1, 2, 3, 4]))
    at.add(np.array([63, 1000]), np.array([5, 6]))
    places, sums = at.harvest()
    assert places.tolist() == [0, 63, 64, 1000, 65535] and sums.tolist() == [1, 7, 3, 6, 4]
    assert not at.sums.any() and not at.bits.any()


def test_large_counts_stay_whole():
    size = np.array([4 * 10**9])
    assert lexical.gains(np.array([3]), size, 10**10, 7 * 10**18).tolist() == [3 * 10**9 // (3000 + 20 * (50 + 50 * 4 * 10**9 * 10**10 // (7 * 10**18)))]


def test_lexical_edges(spark):
    docs, items = (spark.createDataFrame(r, f"{n}_id long, text string") for n, r in (("doc", [(1, "alpha " * 100_000 + "beta"), (2, None), (3, ""), (1, "alpha"), (None, "alpha")]), ("item", [(1, "ALPHA"), (2, "beta beta")])))
    same(lexical.ranked(docs, items).collect(), brute_ranking([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()]))
    assert lexical.ranked(docs.where("false"), items).count() == 0
    assert lexical.ranked(docs, items.where("false")).count() == 0
