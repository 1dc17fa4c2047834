"""Embeddings in batches, key phrases, headers, entities and the parser's one partitioning."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankspark.operators import embedding, entities, keyphrases, resume, segment
from rankspark.plans import parse as plans
from rankspark.sources import files

# --- embeddings ------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=40), st.integers(1, 9), st.integers(1, 200))
def test_calls_hold_every_text_once_within_bounds(lengths, rows, cost):
    got = list(embedding.calls(lengths, rows, cost))
    assert sorted(i for own in got for i in own) == list(range(len(lengths)))
    for own in got:
        assert len(own) == 1 or len(own) <= rows and len(own) * max(1, max(lengths[i] for i in own)) <= cost


def test_vectors_do_not_depend_on_calls():
    rng = random.Random(1)
    texts = [None, "", *(" ".join(rng.choice(["ab", "c", "def"]) for _ in range(rng.randint(1, 40))) for _ in range(60))]
    encode = lambda every, dim: [embedding.hash_embedding(t, dim) for t in every]
    by = [embedding.encoded(embedding.Embedder(lambda: encode, "x", rows, cost), encode, texts, 32) for rows, cost in ((1, 1), (7, 300), (64, 1 << 20))]
    for got in by[1:]:
        assert all((a is None and b is None) or (a == b).all() for a, b in zip(by[0], got))
    assert by[0][0] is None and not by[0][1].any()


def test_a_worker_opens_one_model_and_calls_it_rarely(spark, tmp_path):
    log = str(tmp_path / "log")

    def note(what):
        with open(log, "a") as f:
            f.write(what + "\n")

    def make():
        note("open")

        def encode(texts, dim):
            note("call")
            return np.array([[len(t)] * dim for t in texts])

        return encode

    df = spark.range(0, 1000, 1, 2).select("id", F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    got = df.select("id", embedding.embed(F.col("text"), 3, embedding.Embedder(make, str(tmp_path), most_rows=16)).alias("e"))
    assert got.where("e[0] = id % 50 and size(e) = 3").count() == 1000
    found = open(log).read().split()
    # 50 distinct texts in each of two tasks, 16 a call
    assert found.count("open") <= 2 and found.count("call") == 8


def test_embedders_of_the_wrong_width_are_told(spark):
    wrong = embedding.Embedder(lambda: lambda texts, dim: np.zeros((len(texts), dim + 1)), "wide")
    with pytest.raises(ValueError, match="wide"):
        embedding.encoded(wrong, wrong.open(), ["a"], 4)
    short = embedding.Embedder(lambda: None, "short", most_chars=3)
    assert embedding.encoded(short, lambda t, dim: [[len(x)] * dim for x in t], ["abcdef", "ab"], 1) == [[3.0], [2.0]]


# --- key phrases ---------------------------------------------------------------------------


def dense_mmr(doc, words, n, dim):
    """The same with dense vectors and a full sort, ties at nine places to the first phrase."""
    every = sorted({" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)})
    v = np.array([embedding.hash_embedding(p, dim) for p in every])
    near, like, out = v @ doc, np.full(len(every), -np.inf), []
    score = near
    while len(out) < min(n, len(every)):
        best = max((i for i in range(len(every)) if i not in out), key=lambda i: (round(score[i], 9), -i))
        out.append(best)
        like = np.maximum(like, v @ v[best])
        score = 0.5 * near - 0.5 * like
    return [every[i] for i in out]


def test_sparse_phrases_equal_dense_ones():
    rng = random.Random(4)
    for dim in (8, 64, 256):
        for _ in range(25):
            words = [rng.choice("alpha beta gamma delta eps zeta eta".split()) for _ in range(rng.randint(0, 30))]
            doc = embedding.hash_embedding(" ".join(words) + " and more", dim)
            assert keyphrases.hashed_mmr(doc, words, 12) == (dense_mmr(doc, words, 12, dim) if words else [])


def test_few_phrases_are_scored_again(monkeypatch):
    """The choice stays that of all phrases, ties too, when only the nearest are scored after each one."""
    rng = random.Random(9)
    for nearest in (1, 3, 12):
        monkeypatch.setattr(keyphrases, "NEAREST", nearest)
        for _ in range(12):
            words = [f"w{rng.randint(0, 25)}" for _ in range(rng.randint(10, 60))]
            doc = embedding.hash_embedding(" ".join(words), 64)
            assert keyphrases.hashed_mmr(doc, words, 25) == dense_mmr(doc, words, 25, 64)


def test_phrases_of_many_texts_are_those_of_each(monkeypatch):
    """Texts are looked at together, in any groups, and scored again in any number; blank and one-word texts too."""
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randint(0, 20)}" for _ in range(rng.choice((0, 1, 2, 3, 9, 40)))) for _ in range(40)]
    words = [[w for w in t.split() if w != "w3"] for t in texts]
    expected = [dense_mmr(embedding.hash_embedding(t, 64), w, 9, 64) if w else [] for t, w in zip(texts, words)]
    for most_texts, most_chars, nearest in ((1, 10, 384), (7, 1000, 3), (100, 60, 1), (100, 10**6, 384)):
        monkeypatch.setattr(keyphrases, "MOST_TEXTS", most_texts)
        monkeypatch.setattr(keyphrases, "MOST_CHARS", most_chars)
        monkeypatch.setattr(keyphrases, "NEAREST", nearest)
        monkeypatch.setattr(keyphrases, "BLOCK", 5)
        assert keyphrases.hashed_phrases(texts, words, 9, 64) == expected
    assert keyphrases.hashed_phrases([], [], 9, 64) == []


def test_a_word_or_pair_of_several_texts_is_hashed_once(monkeypatch):
    hashed, own = [], embedding._hashes
    monkeypatch.setattr(embedding, "_hashes", lambda grams: own(hashed.extend(grams) or hashed[-len(grams) :]) if grams else own(grams))
    texts = ["graph query engine", "query engine graph query", "graph query engine"]
    keyphrases.hashed_phrases(texts, [t.split() for t in texts], 5, 64)
    assert sorted(hashed) == [b"engine", b"engine graph", b"graph", b"graph query", b"query", b"query engine"]


def test_junk_and_name_phrases_are_left_out(spark):
    df = spark.createDataFrame([("ivan petrov 2020 11 developed graph database 12.05", "Ivan Petrov"), ("ivan petrov graph", None)], "text string, name string")
    own, free = (r.phrases for r in keyphrases.keyphrases(df, name="name").collect())
    assert "graph database" in own and "ivan petrov" in free
    assert not {"ivan", "petrov", "ivan petrov", "ivan petrov 2020", "2020", "11", "developed", "2020 11"} & set(own)


def test_phrases_by_a_model_and_no_session_setting(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    df = spark.createDataFrame([("graph database engines and graph query planning",), (None,)], "text string")
    by_model = keyphrases.keyphrases(df, embedder=embedding.Embedder(lambda: lambda t, dim: [embedding.hash_embedding(x, dim) for x in t], "hash"))
    assert len(by_model.first().phrases) > 3 and by_model.where("text is null").first().phrases == []
    keyphrases.keyphrases(df).collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


# --- headers and entities --------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("abc &é", max_size=9), min_size=1, max_size=6), st.text("abc &éx", max_size=12))
def test_many_patterns_at_once(patterns, text):
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    assert segment.Patterns(patterns).lengths(text) == [lcs(p, text) for p in patterns]


def test_long_lines_are_told_without_trimming_them(spark):
    """Longer than 40 characters, whatever white space is around; an emoji is one character."""
    cores = ["x" * 40, "x" * 41, "x" + " " * 38 + "y", "x" + " \n" * 20 + "y", "😀" * 40, "😀" * 41, "", "a b", "é" * 39 + "\u00a0z"]
    texts = [a + t + b for t in cores for a, b in (("", ""), (" \t" * 30, "\n" * 50), ("\u00a0", "\u2003\r\n"))]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", segment.is_long(F.col("text")).alias("long")).collect()
    assert [r.long for r in rows] == [len(r.text.strip()) > 40 for r in rows]


def test_closest_section_takes_the_first_of_the_best():
    for section, aliases in segment.ALIASES.items():
        assert [segment.closest_section(a) for a in aliases] == [section] * len(aliases)
    assert segment.closest_section("") is None and segment.closest_section("lorem ipsum") is None


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab c", min_size=1, max_size=5), max_size=6), st.text("ab cAB.", max_size=30))
def test_automaton_finds_what_a_plain_search_finds(phrases, text):
    names = sorted({p.lower() for p in phrases}, key=lambda p: (-len(p), p))
    expected = [m.span() for m in re.finditer(r"(?<!\w)(?:" + "|".join(map(re.escape, names)) + r")(?!\w)", text.lower())] if names else []
    # a phrase that begins or ends with a blank may stand beside a word in either reading
    assert entities.named(entities.automaton(phrases), text) == expected


def test_places_survive_letters_that_grow():
    text = "İİ Kaspi Bank in İzmir"
    (start, end), = entities.named(entities.automaton(["kaspi bank"]), text)
    assert text[start:end] == "Kaspi Bank"


def test_entities_of_two_models(spark):
    ru = lambda v: [{"text": "Иван", "label": "PER", "start": 0, "end": 4, "source": "model_ru"}] if v.startswith("Иван") else []
    en = lambda v: [{"text": "Acme", "label": "ORG", "start": v.index("Acme"), "end": v.index("Acme") + 4, "source": "model_en"}] if "Acme" in v else []
    df = spark.createDataFrame([("Иван at Acme",), ("",), (None,)], "text string")
    assert [[e.text for e in r.entities] for r in entities.extract(df, [], model=(ru, en)).collect()] == [["Иван", "Acme"], [], []]


# --- the parser ------------------------------------------------------------------------------

LINE = "doc_id long, line_no int, text string, max_font_size double, is_bold boolean, top double, col int, page int"


def test_persons_come_from_the_first_five_lines(spark):
    def model(text):
        return [{"text": m.group(), "label": "PERSON", "start": m.start(), "end": m.end(), "source": "m"} for m in re.finditer("(Anna|Boris) [A-Z][a-z]+", text)]

    rows = [(1, i, t, 10.0, False, float(i), 0, 0) for i, t in enumerate(["curriculum vitae", "of a candidate", "one", "two", "three", "Anna Petrova"], 1)]
    rows += [(2, i, t, 10.0, False, float(i), 0, 0) for i, t in enumerate(["cv", "x", "y", "z", "by Boris Ivanov"], 1)]
    got = plans.parse(spark.createDataFrame(rows, LINE), model=model, fallback=False).orderBy("doc_id").collect()
    assert [r.parsed.name for r in got] == [None, "Boris Ivanov"]


def test_documents_are_read_once_and_dealt_once(spark, tmp_path):
    texts = [(i, f"Ivan Petrov\nEXPERIENCE\nAcme Inc\n05/2019 - 07/2021 engineer {i}\nSKILLS\npython, sql, spark, scala") for i in range(20)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    lines = files.text_lines(spark.read.parquet(f"{tmp_path}/d"))
    got = plans.parse(lines)
    assert {(r.parsed.name, len(r.parsed.skills), len(r.parsed.experience)) for r in got.collect()} == {("Ivan Petrov", 4, 1)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert f"{tmp_path}/d" not in plan and "Exchange hashpartitioning" not in plan


def test_a_joinless_header_match_keeps_all_lines(spark):
    rows = [(1, i, t, 10.0, False, float(i), 0, 0) for i, t in enumerate(["SKILLS", "python", "SKILLS", None, "", "EDUCATION:"], 1)] + [(None, 1, "SKILLS", 10.0, False, 1.0, 0, 0)]
    df = spark.createDataFrame(rows, LINE)
    got = segment.placed(df).orderBy(F.asc_nulls_last("doc_id"), "line_no").collect()
    assert [(r.header, r.section) for r in got] == [("skills", "skills"), (None, "skills"), ("skills", "skills"), (None, "skills"), (None, "skills"), ("education", "education"), ("skills", "skills")]
    assert resume.skills(segment.sections(df)).count() == 1
