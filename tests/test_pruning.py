"""Exact rankings that leave out groups by their bounds."""

import random

import numpy as np
import pytest

from rankspark.operators import blocks, ranking, tfidf


def test_visit_equals_a_full_sort_and_skips():
    rng = np.random.default_rng(1)
    for k in (1, 3, 50):
        score = np.round(rng.normal(size=(5, 40)), 1)  # many ties
        ids = rng.permutation(40)
        groups = [ids[i : i + 8] for i in range(0, 40, 8)]
        bound = np.stack([score[:, i : i + 8].max(axis=1) for i in range(0, 40, 8)], axis=1) + 0.05
        best = blocks.Best(5, k)
        met = blocks.visit(best, groups, bound, lambda own, g: score[own, 8 * g : 8 * g + 8])
        for q in range(5):
            order = sorted(range(40), key=lambda j: (-score[q, j], ids[j]))[:k]
            n = min(k, 40)
            assert best.ids[q, :n].tolist() == [ids[j] for j in order]
        assert met <= 25 and (k > 1 or met < 20)


def cosine_ranking(q, c, k):
    out = []
    for i, u in q:
        s = [(-round(float(np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v)), 9), j) for j, v in c]
        out += [(i, j, r + 1) for r, (_, j) in enumerate(sorted(s)[:k])]
    return sorted(out)


def test_clustered_vectors_skip_most_groups(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 24)) * 5
    c = [(i, (centres[i % 40] + rng.normal(size=24) * 0.3).tolist()) for i in range(4000)]
    q = [(i, (centres[i] + rng.normal(size=24) * 0.3).tolist()) for i in range(12)]
    kept = spark.createDataFrame(c, "candidate_id long, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame(q, "query_id long, embedding array<double>")
    counts = tuple(spark.sparkContext.accumulator(0) for _ in range(2))
    got = ranking.semantic(asked, kept, 10, counts).collect()
    assert sorted((r.query_id, r.candidate_id, r.rank) for r in got) == cosine_ranking(q, c, 10)
    assert counts[1].value < 0.2 * counts[0].value


@pytest.mark.parametrize("boost", [0.0, 0.1])
def test_terms_that_differ_skip_most_groups(spark, boost):
    rng = random.Random(3)
    words = [[f"w{t}x{i}" for i in range(30)] for t in range(20)]
    text = lambda t, n: " ".join(rng.choice(words[t]) for _ in range(n))
    docs = [(i, text(i % 20, 25), f"t{i % 20}", i % 7 > 0) for i in range(3000)]
    jobs = [(i, text(i % 20, 9), f"t{i % 20}", i != 3) for i in range(10)]
    schema = "id long, text string, category string, boosts boolean"
    d, j = (spark.createDataFrame(r, schema).coalesce(1) for r in (docs, jobs))
    vocab = tfidf.vocabulary(d.unionByName(j), "text").cache()
    dv, jv = (tfidf.vectors(x, "id", "text", vocab, carry=("category", "boosts")).cache() for x in (d, j))
    counts = tuple(spark.sparkContext.accumulator(0) for _ in range(2))
    got = tfidf.best(jv, dv.coalesce(1), 10, boost, counts).collect()
    sparse = {x: {r.id: (dict(zip(r.at, r.w)), r.category, r.boosts) for r in df.collect()} for x, df in (("d", dv), ("j", jv))}
    expected = []
    for i, (w, cat, b) in sparse["j"].items():
        s = [(-round(sum(v * x.get(t, 0) for t, v in w.items()) + boost * (cat == c2 and b and b2), 9), n) for n, (x, c2, b2) in sparse["d"].items()]
        expected += [(i, n, r + 1) for r, (_, n) in enumerate(sorted(s)[:10])]
    assert sorted((r.query_id, r.candidate_id, r.rank) for r in got) == sorted(expected)
    assert counts[1].value < 0.3 * counts[0].value


def test_candidates_without_shared_terms_rank_by_id(spark):
    schema = "id long, at array<int>, w array<double>, category string, boosts boolean"
    q = spark.createDataFrame([(1, [0], [1.0], "IT", True)], schema)
    c = spark.createDataFrame([(i, [], [], "IT" if i == 5 else "HR", True) for i in range(8) if i != 3] + [(3, [0], [0.05], "HR", True), (8, [], [], "IT", False)], schema)
    got = tfidf.best(q, c, 4).orderBy("rank").collect()
    assert [(r.candidate_id, round(r.score, 2)) for r in got] == [(5, 0.1), (3, 0.05), (0, 0.0), (1, 0.0)]
    assert tfidf.best(q, c.where("false"), 4).count() == 0 and tfidf.best(q.where("false"), c, 4).count() == 0


@pytest.mark.parametrize("n, min_df", [(1, 1), (12, 2), (40, 3), (5000, 2)])
def test_most_frequent_terms_equal_a_full_count(spark, n, min_df):
    from rankspark.operators import frequent

    rng = random.Random(n)
    rows = [[f"w{int(rng.paretovariate(0.6)) % 900}" for _ in range(rng.randint(0, 30))] for _ in range(600)]
    df, ctf = {}, {}
    for r in rows:
        found = [*r, *map(" ".join, zip(r, r[1:]))]
        for t in set(found):
            df[t] = df.get(t, 0) + 1
        for t in found:
            ctf[t] = ctf.get(t, 0) + 1
    expected = sorted((t for t in df if df[t] >= min_df), key=lambda t: (-ctf[t], t))[:n]
    counts = tuple(spark.sparkContext.accumulator(0) for _ in range(2))
    got = frequent.most_frequent(spark.createDataFrame([(r,) for r in [*rows, None]], "w array<string>").repartition(4), n, min_df, counts).collect()
    assert sorted((r.term, r.df, r.ctf) for r in got) == sorted((t, df[t], ctf[t]) for t in expected)
    assert counts[0].value > 0 and (n == 5000 or counts[1].value < 0.3 * counts[0].value)


def test_most_frequent_terms_of_nothing(spark):
    from rankspark.operators import frequent

    for rows in ([], [(None,), ([],)]):
        assert frequent.most_frequent(spark.createDataFrame(rows, "w array<string>"), 3).count() == 0


def test_sketch_places_are_fixed():
    from rankspark.operators import frequent

    at = frequent.places(["a", "слово дом", ""], frequent.width(20_000))
    assert at.shape == (frequent.DEPTH, 3) and at.max() < frequent.width(20_000) == 1 << 20
    assert (at == frequent.places(["a", "слово дом", ""], 1 << 20)).all() and frequent.width(10**9) == frequent.MOST_CELLS


def test_terms_spread_over_the_sketch():
    """A pair's bits come from its words' and are those of the joined text; few terms share a cell."""
    import numpy as np
    import pyarrow as pa

    from rankspark.operators import frequent

    words = [f"w{i}" for i in range(3000)] + ["слово", "e", ""]
    terms, bits, df, ctf = next(frequent._counted([pa.RecordBatch.from_arrays([pa.array([words, None, words[:2], ["e", "e"]])], ["w"])]))
    at = frequent.places(terms.to_pylist(), 1 << 20)
    assert (frequent._cells(bits, 1 << 20) == at).all() and min(len(np.unique(row)) for row in at) > 0.99 * len(terms)
    got = dict(zip(terms.to_pylist(), zip(df.tolist(), ctf.tolist())))
    assert got["w0"] == got["w0 w1"] == (2, 2) and got["w7 w8"] == (1, 1) and got["e"] == (2, 3) and got["e e"] == (1, 1) and len(got) == len(terms)


def test_a_task_counts_few_words_at_once(monkeypatch):
    """An Arrow batch of any size is counted in parts of bounded numbers of words, a longer text alone."""
    import pyarrow as pa

    from rankspark.operators import frequent

    monkeypatch.setattr(frequent, "HELD_WORDS", 100)
    rows = [["a", "b"]] * 1000 + [["c"] * 500] + [None] * 3
    parts = list(frequent._counted([pa.RecordBatch.from_arrays([pa.array(rows)], ["w"])]))
    assert len(parts) > 20 and sum(dict(zip(t.to_pylist(), n.tolist())).get("a b", 0) for t, _, _, n in parts) == 1000
    assert any(dict(zip(t.to_pylist(), n.tolist())).get("c c") == 499 for t, _, _, n in parts)


def test_candidates_meet_queries_a_block_at_a_time(spark, monkeypatch):
    """Blocks of candidates are neither written nor joined: one table of plain rows goes to the task."""
    schema = "id long, at array<int>, w array<double>"
    q = spark.createDataFrame([(i, [i % 7], [1.0]) for i in range(300)], schema)
    c = spark.createDataFrame([(i, [i % 7], [1.0 / (1 + i)]) for i in range(200)], schema)
    few = tfidf.best(q, c, 3)
    assert "Join" not in few._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in few._jdf.queryExecution().executedPlan().toString()
    found = sorted(map(tuple, few.collect()))
    monkeypatch.setattr(tfidf, "MOST_ASKED", 10)
    assert found == sorted(map(tuple, tfidf.best(q, c, 3).collect())) and len(found) == 900


def test_large_files_make_more_tasks(spark, tmp_path, monkeypatch):
    from rankspark.operators import blocks

    path = f"{tmp_path}/a [1] b"
    spark.range(2000).coalesce(1).write.parquet(path)
    rows = spark.read.parquet(path.replace("[", "\\[").replace("]", "\\]"))
    monkeypatch.setattr(blocks, "TASK_BYTES", 100)
    out = blocks.spread(rows)
    assert out.rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism and out.count() == 2000
