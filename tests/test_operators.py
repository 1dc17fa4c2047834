"""Parser, ranking, store and stream operators."""

import io
import itertools
import math
import random
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankspark.operators import entities, keyphrases, layout, ranking, resume, segment, store, tfidf
from rankspark.plans import engine as engines
from rankspark.plans import parse as plans
from rankspark.sources import files
from rankspark.streaming import ingest

LINE = "doc_id long, line_no int, text string, max_font_size double, is_bold boolean, top double, col int, page int"


def lines(spark, *texts, bold=(), doc=1):
    return spark.createDataFrame([(doc, i, t, 10.0, i in bold, float(i), 0, 0) for i, t in enumerate(texts, 1)], LINE)


def placed(spark, section, *texts, orgs=()):
    at = lines(spark, *texts).withColumn("section", F.lit(section))
    return at, spark.createDataFrame([(1, list(orgs))], "doc_id long, orgs array<string>")


# --- segments -------------------------------------------------------------------------------


def test_sections(spark):
    got = segment.sections(lines(spark, "intro", "Experience:", "job", "Skills", bold=(2, 4))).orderBy("line_no").collect()
    assert [(r.text, r.section) for r in got] == [("intro", "about"), ("job", "experience")]


def test_headers_need_a_signal_and_a_close_alias(spark):
    at = segment.headers(lines(spark, "skills", "SKILLS", "НАВЫКИ", "Experiense", "x" * 50, "Work experience", bold=(4, 5, 6))).orderBy("line_no").collect()
    assert [r.header for r in at] == [None, "skills", "skills", "experience", None, "experience"]


def brute_indel(a, b):
    def lcs(i, j):
        if i == len(a) or j == len(b):
            return 0
        return 1 + lcs(i + 1, j + 1) if a[i] == b[j] else max(lcs(i + 1, j), lcs(i, j + 1))

    return 100.0 if not a and not b else 200.0 * lcs(0, 0) / (len(a) + len(b))


@settings(max_examples=60, deadline=None)
@given(st.text("ab c", max_size=7), st.text("ab c", max_size=7))
def test_indel(a, b):
    assert segment.indel_ratio(a, b) == pytest.approx(brute_indel(a, b))


# --- experience and education -----------------------------------------------------------------


def jobs(spark, *texts, orgs=()):
    return [tuple(r) for r in resume.experience(*placed(spark, "experience", *texts, orgs=orgs)).orderBy("block").select("organization", "role", "start", "end").collect()]


def test_sticky_organisation(spark):
    assert jobs(spark, "VBox", "ML Engineer 2022 - 2023", "Data Analyst 2020 - 2022") == [("VBox", "ML Engineer", "2022", "2023"), ("VBox", "Data Analyst", "2020", "2022")]


def test_organisation_on_the_dated_line(spark):
    assert jobs(spark, "Ryte.AI Oct 2023 - Dec 2024", "• did things", "Junior Data Analyst", "more text") == [("Ryte.AI", "Junior Data Analyst", "Oct 2023", "Dec 2024")]
    assert jobs(spark, "Ryte.AI Oct 2023 - Dec 2024", "Senior Dev 2020 - 2021") == [("Ryte.AI", None, "Oct 2023", "Dec 2024"), ("Ryte.AI", "Senior Dev", "2020", "2021")]


def test_organisation_inside_the_role(spark):
    assert jobs(spark, "Backend Developer, Kaspi Bank 2019 - present", orgs=["Kaspi Bank"]) == [("Kaspi Bank", "Backend Developer", "2019", "present")]
    assert jobs(spark, "Kaspi Bank 2019 - 2020", orgs=["KASPI BANK"]) == [("KASPI BANK", None, "2019", "2020")]


def test_priority_differs_between_experience_and_education(spark):
    text = ("KBTU", "BSc, Nazarbayev University 2019 - 2023")
    got = resume.education(*placed(spark, "education", *text, orgs=["Nazarbayev University"])).select("institution", "degree", "start", "end").collect()
    assert [tuple(r) for r in got] == [("Nazarbayev University", "BSc", "2019", "2023")]
    assert jobs(spark, *text, orgs=["Nazarbayev University"])[0][0] == "KBTU"


def test_later_line_names_the_institution(spark):
    got = resume.education(*placed(spark, "education", "Master 2020", "at Satbayev University", orgs=["Satbayev University"])).select("institution", "degree", "end", "raw").first()
    assert tuple(got) == ("Satbayev University", "Master", "2020", "Master 2020\nat Satbayev University")


def test_skills_and_names(spark):
    at, _ = placed(spark, "skills", "• Языки: Python (FastAPI, Django), SQL, 2020", "sql; Docker")
    assert [r.skill for r in resume.skills(at).orderBy("pos").collect()] == ["Python (FastAPI, Django)", "SQL", "Docker"]
    assert resume.names(lines(spark, "Resume", "Ivan Petrov", "Anna Lee")).first().name == "Ivan Petrov"
    assert resume.names(lines(spark, "a", "b", "c", "Ivan Petrov")).count() == 0


# --- entities, layout, phrases ---------------------------------------------------------------------


def test_overlaps():
    e = lambda s, t, src="model": {"text": "x", "label": "ORG", "start": s, "end": t, "source": src}
    assert entities.keep_longest([e(0, 10), e(2, 8), e(9, 20), e(0, 10, "rule_x")]) == [e(0, 10, "rule_x"), e(9, 20)]
    assert entities.keep_longest([e(0, 4), e(1, 20)]) == [e(0, 4)]


def test_entities(spark):
    df = spark.createDataFrame([(1, "Worked at astana hub with Kaspi Bank and IBM"), (2, None)], "id long, text string")
    got = {r.id: [x.text for x in r.entities] for r in entities.extract(df, ["Astana Hub"]).collect()}
    assert got == {1: ["astana hub", "Kaspi Bank", "IBM"], 2: []}


WORD = "doc_id long, page int, seq int, text string, x0 double, x1 double, top double, size double, fontname string, page_width double"


def test_two_columns(spark):
    rows = [(1, 0, i, f"{side}{i}", x, x + 40.0, 20.0 * (i // 2) + (i % 2), 10.0, "Bold" if i == 0 else "Roman", 600.0) for side, x in (("L", 60.0), ("R", 400.0)) for i in range(40)]
    assert layout.gutters(spark.createDataFrame(rows, WORD)).count() == 0  # nothing but two heaps: the median is zero
    rows += [(1, 0, 100 + i, "n", i * 12.0 + 1, i * 12.0 + 11, 2000.0 + 10 * i, 10.0, "Roman", 600.0) for i in range(50)]
    df = spark.createDataFrame(rows, WORD)
    assert 90 < layout.gutters(df).first().gutter < 420
    got = layout.lines(df).orderBy("line_no").where("text != 'n'").collect()
    assert [r.col for r in got] == [0] * 20 + [1] * 20 and got[0].text == "L0 L1" and got[0].is_bold and not got[1].is_bold


def test_lines_cluster_by_their_first_word(spark):
    rows = [(1, 0, i, t, float(i), i + 1.0, top, None, None, 600.0) for i, (t, top) in enumerate([("a", 10.0), ("b", 12.5), ("c", 13.5), ("d", 16.0)])]
    assert [r.text for r in layout.lines(spark.createDataFrame(rows, WORD)).orderBy("line_no").collect()] == ["a b", "c d"]


def test_mmr_and_phrases(spark):
    import numpy as np

    v = np.array([[1.0, 0.0], [0.99, 0.14], [0.0, 1.0]])
    assert keyphrases.mmr(np.array([1.0, 0.1]), v, 2) [0] in (0, 1) and keyphrases.mmr(np.array([1.0, 0.1]), v, 3)[:0] == []
    df = spark.createDataFrame([("deep learning models for Ivan Petrov and deep learning", "Ivan Petrov"), ("", None)], "text string, name string")
    got = [r.phrases for r in keyphrases.keyphrases(df, name="name").collect()]
    assert any("deep learning" in p for p in got[0]) and not any(p == "ivan petrov" for p in got[0]) and got[1] == []


def test_mmr_in_blocks_is_mmr():
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    most = []

    def vectors(found):
        most.append(len(found))
        return x[[int(p) for p in found]]

    assert keyphrases.mmr_of(x[:9].sum(axis=0), list(map(str, range(500))), 25, vectors, block=37) == keyphrases.mmr(x[:9].sum(axis=0), x, 25)
    assert max(most) == 37


def test_phrase_queries_read_documents(spark, tmp_path):
    from rankspark.plans import catalogue

    text = "Ivan Petrov\nmachine learning engineer building recommendation systems at Kaspi Bank"
    spark.createDataFrame([(1, text, "en", "a", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert catalogue.parse_documents(spark, str(tmp_path)).first().n_skills > 0
    assert "recommendation" in catalogue.keyphrases_top(spark, str(tmp_path)).where("doc_id = 1").first().phrases
    assert catalogue.entities_extract(spark, str(tmp_path)).where("doc_id = 1").first().orgs


# --- ranking ----------------------------------------------------------------------------------------


def ranked(spark, **lists):
    return {k: spark.createDataFrame([(1, c, i) for i, c in enumerate(v, 1)], "query_id long, candidate_id long, rank int") for k, v in lists.items()}


def test_fusion(spark):
    r = ranked(spark, a=[1, 2], b=[2, 3])
    got = ranking.fuse([r["a"], r["b"]], 5).orderBy("rank").collect()
    assert [x.candidate_id for x in got] == [2, 1, 3] and got[0].score == pytest.approx(1 / 62 + 1 / 61)
    r = ranked(spark, a=[1], b=[2])
    assert [x.candidate_id for x in ranking.fuse([r["a"], r["b"]], 5).orderBy("rank").collect()] == [1, 2]


def test_semantic(spark):
    rng = random.Random(1)
    vec = lambda: [rng.gauss(0, 1) for _ in range(6)]
    cands = [(i, vec()) for i in range(50)] + [(50, None), (51, [0.0] * 6), (52, [1.0])]
    cands += [(60 + i, cands[3][1]) for i in range(3)]
    queries = [(i, vec()) for i in range(4)] + [(9, None)]
    got = ranking.semantic(spark.createDataFrame(queries, "query_id long, embedding array<double>"), spark.createDataFrame(cands, "candidate_id long, embedding array<double>").repartition(5), 7)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    for q, v in queries[:4]:
        best = sorted((-round(cos(v, c), 9), i) for i, c in cands if c and len(c) == 6 and any(c))[:7]
        assert [r.candidate_id for r in got.where(F.col("query_id") == q).orderBy("rank").collect()] == [i for _, i in best]
    assert got.where("query_id = 9").count() == 0


def test_scopes(spark):
    df = spark.createDataFrame([("resumeXcsvY1",), ("resume_csv_1",), ("cv/1",)], "source_file string")
    assert {r[0] for r in ranking.production(df).collect()} == {"cv/1"}
    assert ranking.in_scope(df, "eval").count() == 2


def brute_tfidf(corpus, n_max, min_df=2):
    import re

    def terms(t):
        w = [x for x in re.findall(r"\w\w+", t.lower()) if x not in tfidf.STOP_WORDS]
        return w + [" ".join(p) for p in zip(w, w[1:])]

    tf = {i: {} for i in corpus}
    for i, t in corpus.items():
        for x in terms(t):
            tf[i][x] = tf[i].get(x, 0) + 1
    df, ctf = {}, {}
    for c in tf.values():
        for x, n in c.items():
            df[x], ctf[x] = df.get(x, 0) + 1, ctf.get(x, 0) + n
    vocab = sorted((x for x in df if df[x] >= min_df), key=lambda x: (-ctf[x], x))[:n_max]
    idf = {x: math.log((1 + len(corpus)) / (1 + df[x])) + 1 for x in vocab}
    w = {i: {x: (1 + math.log(n)) * idf[x] for x, n in c.items() if x in idf} for i, c in tf.items()}
    return {i: {x: v / math.sqrt(sum(u * u for u in c.values())) for x, v in c.items()} for i, c in w.items()}


def test_tfidf(spark):
    rng = random.Random(3)
    words = "alpha beta gamma delta the and модель данные".split()
    corpus = {i: " ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for i in range(25)}
    df = spark.createDataFrame(list(corpus.items()), "id long, text string")
    _, w = tfidf.fit(df, "id", "text", max_features=12)
    expected = brute_tfidf(corpus, 12)
    got = {(r.id, r.term): r.w for r in w.collect()}
    assert got == pytest.approx({(i, x): v for i, c in expected.items() for x, v in c.items()})
    sims = tfidf.similarities(w.where("id < 3"), w)
    found = tfidf.search(df.where("id < 3").select(F.col("id").alias("query_id")), df.select(F.col("id").alias("candidate_id")), sims, 25)
    for q in range(3):
        best = sorted((-round(sum(v * expected[c].get(x, 0) for x, v in expected[q].items()), 9), c) for c in corpus)
        assert [r.candidate_id for r in found.where(F.col("query_id") == q).orderBy("rank").collect()] == [c for _, c in best]


def test_boost_ranks_candidates_without_shared_terms(spark):
    q = spark.createDataFrame([(1, "IT", True)], "query_id long, category string, boosts boolean")
    c = spark.createDataFrame([(i, "IT" if i == 5 else "HR", True) for i in range(8)] + [(8, "IT", False)], "candidate_id long, category string, boosts boolean")
    sims = spark.createDataFrame([(1, 3, 0.05)], "query_id long, candidate_id long, sim double")
    got = tfidf.search(q, c, sims, 4).orderBy("rank").collect()
    assert [(r.candidate_id, round(r.score, 2)) for r in got] == [(5, 0.1), (3, 0.05), (0, 0.0), (1, 0.0)]


def test_rerank_degrades(spark):
    short = spark.createDataFrame([(1, c, i, s) for i, (c, s) in enumerate([(1, 0.9), (2, 0.8), (3, 0.7)], 1)], "query_id long, candidate_id long, rank int, score double")
    queries = spark.createDataFrame([(1, "python sql")], "query_id long, query_text string")
    cands = spark.createDataFrame([(1, "java"), (2, "python sql")], "candidate_id long, raw_text string")
    assert [r.candidate_id for r in ranking.rerank(short, queries, cands, 2).orderBy("rank").collect()] == [2, 1]
    broken = lambda df: df.withColumn("answer", F.when(F.col("candidate_id") == 3, '{"score": 0.85, "explanation": "ok"}').otherwise("oops"))
    got = ranking.rerank(short, queries, cands, 3, broken).orderBy("rank").collect()
    assert [(r.candidate_id, r.score, r.explanation) for r in got] == [(1, 0.9, None), (3, 0.85, "ok"), (2, 0.8, None)]


def test_metrics(spark):
    found = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, candidate_id long, rank int")
    rel = spark.createDataFrame([(1, 11), (3, 1)], "query_id long, candidate_id long")
    at = {r.query_id: r for r in ranking.metrics(spark.createDataFrame([(1,), (2,), (3,)], "query_id long"), found, rel).collect()}
    assert at[1].p_at_5 == pytest.approx(0.2) and at[1].mrr == 0.5 and at[1].ndcg_5 == pytest.approx(1 / math.log2(3))
    assert all(at[q][m] == 0 for q in (2, 3) for m in ("p_at_1", "mrr", "ndcg_5"))
    assert ranking.random_baseline(24)[1] == pytest.approx(1 / 24)


def test_classifier(spark):
    rows = [(i, ("python code server " if i % 2 else "salary hiring office ") * 3, "IT" if i % 2 else "HR") for i in range(20)]
    df = spark.createDataFrame(rows, "id long, text string, category string")
    vocab, w = tfidf.fit(df, "id", "text")
    got = {r.id: r.category for r in tfidf.classifier(w, vocab, df.select("id", "category"), max_iter=20)(w).collect()}
    assert got == {r[0]: r[2] for r in rows}


def test_classifier_leaves_vectors_where_they_are(spark):
    """Categories come with the vectors and are added to them by no join; a row without a term has none."""
    rows = [(i, ("python code server " if i % 2 else "salary hiring office ") * 3, "IT" if i % 2 else "HR") for i in range(20)] + [(20, "", "IT"), (21, None, None), (22, "python server", None)]
    df = spark.createDataFrame(rows, "id long, text string, category string")
    vocab = tfidf.vocabulary(df, "text").cache()
    found = tfidf.vectors(df, "id", "text", vocab, carry=("category",)).cache()
    got = tfidf.classifier(found, vocab, max_iter=20)(found)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString() and set(got.columns) == {"id", "at", "w", "category"}
    assert {r.id: r.category for r in got.collect()} == {r[0]: r[2] for r in rows[:20]} | {20: None, 21: None, 22: "IT"}
    assert tfidf.classifier(found, vocab, df.select("id", "category"), max_iter=20)(found).where("id < 20").select("id", "category").orderBy("id").collect() == [(r[0], r[2]) for r in rows[:20]]


# --- files ---------------------------------------------------------------------------------------------


def docx(*paragraphs, table=None):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, b=False, size=None: f"<w:p><w:r><w:rPr>{'<w:b/>' if b else ''}{f'<w:sz w:val=\"{size}\"/>' if size else ''}</w:rPr><w:t>{t}</w:t></w:r></w:p>"
    body = "".join(p(*x) if isinstance(x, tuple) else p(x) for x in paragraphs)
    if table:
        body += "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:tcPr>{props}</w:tcPr>{p(t)}</w:tc>" for t, props in row) + "</w:tr>" for row in table) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document {w}><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_docx_lines():
    merged = '<w:vMerge w:val="restart"/>', "<w:vMerge/>"
    got = files.docx_lines(docx("intro", ("Skills", True, 28), " ", table=[[("a1", ""), ("b1", merged[0])], [("a2", ""), ("", merged[1])], [("wide", '<w:gridSpan w:val="2"/>')]]))
    assert [(t, s, b, c) for t, s, b, _, c in got] == [("intro", 10.0, False, 0), ("Skills", 14.0, True, 0), ("a1", 10.0, False, 0), ("a2", 10.0, False, 0), ("wide", 10.0, False, 0), ("b1", 10.0, False, 1)]


def test_extract_lines_isolates_failures(spark):
    rows = [(1, "/x/a.docx", docx("Ivan Petrov", "text")), (2, "/x/b.DOCX", b"not a zip"), (3, "/x/c.txt", b"x"), (4, "/x/d.pdf", b"2")]
    words = lambda content: [(0, f"w{i}", i * 10.0, i * 10 + 5.0, 0.0, 9.0, "F", 600.0) for i in range(int(content))]
    good, bad = files.extract_lines(spark.createDataFrame(rows, "doc_id long, path string, content binary"), words)
    assert sorted((r.doc_id, r.text) for r in good.collect()) == [(1, "Ivan Petrov"), (1, "text"), (4, "w0 w1")]
    assert {r.doc_id for r in bad.collect()} == {2, 3}


def test_readers(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "1_hr.json").write_text('{"title": "t", "description": "d",\n "experience": null}')
    (tmp_path / "v" / "2_bad.json").write_text("{")
    (tmp_path / "v" / "3_bad.json").write_text('{"title": "t"}')
    good, bad = files.vacancies_json(spark, str(tmp_path / "v"))
    assert [r.source_filename for r in good.collect()] == ["1_hr.json"] and sorted(r.source_filename for r in bad.collect()) == ["2_bad.json", "3_bad.json"]
    (tmp_path / "r.csv").write_text('ID,Resume_str,Category\n1,"a ""q"",\nb",HR\n2,,IT\n')
    assert [tuple(r) for r in files.resume_csv(spark, str(tmp_path / "r.csv")).orderBy("ID").collect()] == [("1", 'a "q",\nb', "HR"), ("2", "", "IT")]
    (tmp_path / "g.txt").write_text("# names\n Kaspi Bank \n\nKBTU\n")
    assert [r[0] for r in files.gazetteer(spark, str(tmp_path / "g.txt")).collect()] == ["Kaspi Bank", "KBTU"]
    ok, no = files.screen_uploads(spark.createDataFrame([("a.pdf", b"x"), ("a.txt", b"x"), ("b.docx", b""), ("c.pdf", b"x" * 20)], "filename string, content binary"), most=10)
    assert [r.filename for r in ok.collect()] == ["a.pdf"] and {(r.filename, r.status) for r in no.collect()} == {("a.txt", 400), ("b.docx", 400), ("c.pdf", 413)}


# --- store, stream, engine ---------------------------------------------------------------------------------


def test_updates(spark):
    old = spark.createDataFrame([(1, "a", "x@y.kz"), (2, "b", None)], "id long, name string, email string")
    got = store.update_candidates(old, spark.createDataFrame([(1, "  ", None)], "id long, name string, email string"), "name", "email").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, None, "x@y.kz"), (2, "b", None)]
    jobs_ = spark.createDataFrame([(1, "t", "d", "1 y", [1.0]), (2, "t", "d", None, None)], "id long, title string, description string, experience string, embedding array<float>")
    change = spark.createDataFrame([(1, "t", "d", "2 y"), (2, "u", None, None)], "id long, title string, description string, experience string")
    got = {r.id: r for r in store.update_vacancies(jobs_, change, F.array(F.lit(9.0).cast("float"))).collect()}
    assert got[1].embedding == [1.0] and got[1].experience == "2 y" and got[2].embedding == [9.0] and got[2].title == "u"


def test_versions(spark, tmp_path):
    schema = spark.createDataFrame([], "id long, name string").schema
    t = store.Table(spark, f"file://{tmp_path}/t", schema)
    assert t.version() is None and t.read().count() == 0
    t.write(spark.createDataFrame([(1, "a")], schema))
    t.write(store.upsert(t.read(), spark.createDataFrame([(1, "b"), (2, "c")], schema), "id"))
    assert sorted(map(tuple, t.read().collect())) == [(1, "a"), (2, "c")]
    t.write(store.upsert(t.read(), spark.createDataFrame([(1, "b")], schema), "id", force=True))
    assert sorted(map(tuple, t.read().collect())) == [(1, "b"), (2, "c")] and t.version() == 2


@pytest.fixture
def engine(spark, tmp_path):
    from rankspark.config import Settings

    return engines.Engine(spark, f"file://{tmp_path}/engine", Settings(embedding_dim=64))


def test_ingestion_is_idempotent(spark, tmp_path, engine):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "a.docx").write_bytes(docx("Ivan Petrov", "ivan@x.kz +7 701 123 45 67", ("SKILLS", True), "Python, SQL, Docker", ("EXPERIENCE", True), "VBox", "ML Engineer 2022 - 2023"))
    (inbox / "same.docx").write_bytes((inbox / "a.docx").read_bytes())
    (inbox / "bad.docx").write_bytes(b"x")
    (inbox / "_tmp_1_c.docx").write_bytes(docx("left alone"))
    for _ in range(2):
        engine.ingest_once(f"file://{inbox}")
        engine._query.awaitTermination()
        assert engine.status()["error"] is None
        assert engine.candidates.read().count() == 1
    (inbox / "b.docx").write_bytes(docx("Anna Lee", "text"))
    engine.ingest_once(f"file://{inbox}")
    engine._query.awaitTermination()
    got = engine.candidates.read().orderBy("id").collect()
    assert [(r.id, r.name, r.email) for r in got] == [(1, "Ivan Petrov", "ivan@x.kz"), (2, "Anna Lee", None)]
    p = got[0].parsed
    assert p.skills == ["Python", "SQL", "Docker"] and p.phone == "+7 701 123 45 67" and p.languages_detected == ["en"]
    assert [(e.organization, e.role, e.start, e.end) for e in p.experience] == [("VBox", "ML Engineer", "2022", "2023")]
    assert engine.parse_path(f"file://{inbox}")["parsed"] == 0


def test_recommendations(spark, tmp_path, engine):
    (tmp_path / "r.csv").write_text("ID,Resume_str,Category\n" + "".join(f'{i},{t},{c}\n' for i, (t, c) in enumerate([("python sql models", "HR"), ("law court", "IT"), ("python data", "IT"), ("kitchen", "HR")])))
    engine.import_labelled(str(tmp_path / "r.csv"))
    engine.import_labelled(str(tmp_path / "r.csv"))
    assert engine.candidates.read().count() == 4 and engine.list_candidates().count() == 0 and engine.list_candidates(include_eval=True).count() == 4
    job = engine.create_vacancy("Python", "python sql data", source_filename="1_it.json")
    with pytest.raises(engines.Conflict):
        engine.create_vacancy("x", "y", source_filename="1_it.json")
    queries = engine._queries(job, None, None)
    for strategy in ("semantic", "tfidf", "rrf", "llm"):
        got = engine.rank(queries, strategy, 2, "eval").orderBy("rank").collect()
        assert len(got) == 2 and got[0].candidate_id in (1, 3), strategy
    assert engine.recommend(text="python", strategy="tfidf").count() == 0  # evaluation rows are out of scope
    per, averages = engine.evaluate("rrf")
    assert per.count() == 1 and 0 <= averages.first().p_at_1 <= 1
    for bad in ({}, {"job_id": job, "text": "x"}, {"text": ""}, {"text": "x", "top_k": 51}, {"text": "x", "strategy": "rrf", "retriever": "rrf"}):
        with pytest.raises(ValueError):
            engine.recommend(**bad)
    with pytest.raises(engines.VacancyNotFound):
        engine.recommend(job_id=99)
    engine.update_vacancy(job, title="Data")
    assert engine.vacancy(job).first().title == "Data" and engine.health() == {"status": "ok"}
    engine.update_candidate(1, name="Ivan Petrov")
    assert engine.candidate(1).first()["name"] == "Ivan Petrov"
    engine.delete_candidate(1)
    engine.delete_vacancy(job)
    assert engine.candidates.read().count() == 3 and engine.list_vacancies().count() == 0


def test_vacancy_import(spark, tmp_path, engine):
    (tmp_path / "1_hr.json").write_text('{"title": "t", "description": "d"}')
    (tmp_path / "2_it.json").write_text('{"title": "u", "description": "e"}')
    assert engine.import_vacancies(str(tmp_path)) == {"imported": 2, "skipped": 0}
    engine.embed_vacancies()
    assert engine.import_vacancies(str(tmp_path)) == {"imported": 0, "skipped": 2}
    assert engine.list_vacancies().where("has_embedding").count() == 2
    engine.import_vacancies(str(tmp_path), force=True)
    assert engine.list_vacancies().where("has_embedding").count() == 0 and engine.list_vacancies().count() == 2


def test_attachments(spark):
    df = spark.createDataFrame([("1", "a@b", "s", [("CV one.PDF", b"x"), ("pic.png", b"y"), (None, b"z")])], "uid string, sender string, subject string, attachments array<struct<filename:string,payload:binary>>")
    got = ingest.attachments(df).collect()
    assert [(r.filename, r.sanitized) for r in got] == [("CV one.PDF", "CV_one.pdf")]


def test_retries(monkeypatch):
    tries = itertools.count()

    class Query:
        def awaitTermination(self):
            if next(tries) < 2:
                raise RuntimeError("down")

    assert ingest.run_with_retries(Query, retries=2, wait_s=0)
    assert next(tries) == 3


def test_parse_fills_skills_from_phrases(spark):
    got = plans.parse(lines(spark, "Ivan Petrov", "machine learning engineer building recommendation systems")).first()
    assert got.parsed.name == "Ivan Petrov" and len(got.parsed.skills) > 0


def test_uploads(spark, tmp_path, engine):
    one = docx("Ivan Petrov", "text")
    assert engine.upload("My CV.DOCX", one) == 1
    assert engine.candidate(1).first()["source_file"] == "1_My_CV.docx"
    for bad, error in ((("again.docx", one), engines.Conflict), (("x.txt", b"1"), ValueError), (("x.docx", b""), ValueError), (("x.docx", b"no zip"), ValueError)):
        with pytest.raises(error):
            engine.upload(*bad)
    assert engine.candidates.read().count() == 1


def message(sender, *attached):
    from email.message import EmailMessage

    m = EmailMessage()
    m["From"], m["Subject"] = sender, "cv"
    m.set_content("see file")
    for name, data in attached:
        m.add_attachment(data, maintype="application", subtype="octet-stream", filename=name)
    return m.as_bytes()


def test_mail_files(spark, tmp_path):
    from rankspark.sources import mailbox

    (tmp_path / "1.eml").write_bytes(message("a@b", ("Cv.docx", b"x"), ("pic.png", b"y")))
    (tmp_path / "2.eml").write_bytes(b"")
    (tmp_path / "3.eml").write_bytes(message("c@d"))
    got = mailbox.eml_files(spark.read.format("binaryFile").load(str(tmp_path)).where("length > 0"))
    assert sorted((r.sender, [x.filename for x in r.attachments]) for r in got.collect()) == [("a@b", ["Cv.docx", "pic.png"]), ("c@d", [])]
    assert [r.filename for r in ingest.attachments(got).collect()] == ["Cv.docx"]


def test_mailbox_offsets():
    from rankspark.sources import mailbox

    class Box:
        held = {3: message("a@b", ("x.pdf", b"1")), 5: message("c@d")}

        def select(self, *a, **k):
            pass

        def uid(self, what, *a):
            if what == "search":
                low, high = a[1].split()[1].split(":")
                return "OK", [" ".join(str(u) for u in self.held if u >= min(int(low), max(self.held)) and (high == "*" or u <= int(high))).encode()]
            return "OK", [(b"", self.held[int(a[0])])]

    reader = mailbox.MailboxReader({}, Box)
    rows, end = reader.read(reader.initialOffset())
    assert [r[0] for r in rows] == ["3", "5"] and end == {"uid": 5}
    assert [r[1] for r in reader.readBetweenOffsets({"uid": 0}, {"uid": 3})] == ["a@b"]
    rows, end = reader.read(end)
    assert list(rows) == [] and end == {"uid": 5}


def test_mailbox_blocks(spark, tmp_path):
    """The driver asks for the last number only; tasks fetch the blocks; a new batch starts after the last one."""
    from rankspark.sources import mailbox

    held = {u: message(f"{u}@b", ("x.pdf", b"1")) for u in (3, 5, 11)}

    class Box:
        def select(self, *a, **k):
            pass

        def logout(self):
            pass

        def status(self, folder, what):
            return "OK", [f'"{folder}" (UIDNEXT 12 UIDVALIDITY 7)'.encode()]

        def uid(self, what, *a):
            if what == "search":
                low, high = a[1].split()[1].split(":")
                return "OK", [" ".join(str(u) for u in held if int(low) <= u <= int(high)).encode()]
            return "OK", [(b"", held[int(a[0])])]

    class Fake(mailbox.Mailbox):
        @classmethod
        def name(cls):
            return "fakemail"

        def streamReader(self, schema):
            return mailbox.MailboxStream(dict(self.options), Box)

    reader = mailbox.MailboxStream({"block": "4"}, Box)
    end = reader.latestOffset()
    assert end == {"uid": 11, "validity": 7}
    assert [(b.low, b.high) for b in reader.partitions(reader.initialOffset(), end)] == [(0, 4), (4, 8), (8, 11)]
    assert reader.partitions(end, end) == []
    with pytest.raises(ValueError):
        reader.partitions({"uid": 2, "validity": 6}, end)
    spark.dataSource.register(Fake)
    for _ in range(2):  # the second run finds nothing new
        at = spark.readStream.format("fakemail").option("block", "4").load()
        at.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.sender for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["11@b", "3@b", "5@b"]


def test_appended_versions(spark, tmp_path, monkeypatch):
    """Appends add to the version before; old versions stay readable; a write replaces all; long chains are made whole."""
    schema = spark.createDataFrame([], "id long, name string").schema
    t = store.Table(spark, f"file://{tmp_path}/t", schema)
    row = lambda i, n: spark.createDataFrame([(i, n)], schema)
    ids = lambda v=None: sorted(r.id for r in t.read(v).collect())
    t.append(row(1, "a"))
    t.append(row(2, "b"))
    assert ids() == [1, 2] and ids(0) == [1] and t.version() == 1
    (tmp_path / "t" / "a-000000002").mkdir()  # a write that failed
    assert ids() == [1, 2]
    t.write(row(3, "c"))
    t.append(row(4, "d"))
    assert ids() == [3, 4] and ids(1) == [1, 2] and ids(2) == [3]
    monkeypatch.setattr(store, "MOST_PARTS", 2)
    t.append(row(5, "e"))
    assert ids() == [3, 4, 5] and (tmp_path / "t" / "v-000000004").exists()


def files_of(path):
    return {str(f): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_a_change_rewrites_its_partitions_alone(spark, tmp_path):
    schema = spark.createDataFrame([], "id long, name string, email string").schema
    t = store.Table(spark, f"file://{tmp_path}/t", schema, buckets=8)
    t.write(spark.createDataFrame([(i, f"n{i}", None) for i in range(200)] + [(None, "none", None)], schema))
    t.append(spark.createDataFrame([(200, "n200", None)], schema))
    before = files_of(tmp_path / "t")
    change = spark.createDataFrame([(7, "seven")], "id int, name string")  # an int finds a long's partition
    assert t.change(change, lambda at: store.update_candidates(at, change, "name")) == 2
    after = files_of(tmp_path / "t")
    assert before.items() <= after.items()
    assert len({f.rsplit("/", 2)[1] for f in after.keys() - before.keys()}) == 1
    rows = {r.id: r.name for r in t.read().collect()}
    assert rows == {**{i: f"n{i}" for i in range(201)}, None: "none", 7: "seven"}
    assert {r.id: r.name for r in t.read(1).collect()}[7] == "n7"  # the version before is as it was
    assert t.change(change.where("false"), lambda at: at) == 2  # nothing to do
    t.append(spark.createDataFrame([(7, "twice", None)], schema))
    assert t.read().where("id = 7").count() == 2


def test_partitions_that_lose_all_rows_and_other_partitionings(spark, tmp_path):
    schema = spark.createDataFrame([], "id long, name string").schema
    t = store.Table(spark, f"file://{tmp_path}/t", schema, buckets=16)
    t.write(spark.createDataFrame([(1, "a"), (2, "b")], schema))
    gone = spark.createDataFrame([(1,)], "id long")
    t.change(gone, lambda at: store.delete(at, gone, "id"))
    assert [tuple(r) for r in t.read().collect()] == [(2, "b")]
    other = store.Table(spark, f"file://{tmp_path}/t", schema, buckets=4)
    gone = spark.createDataFrame([(2,)], "id long")
    other.append(spark.createDataFrame([(3, "c")], schema))
    other.change(gone, lambda at: store.delete(at, gone, "id"))  # written whole, by the new number
    assert [tuple(r) for r in other.read().collect()] == [(3, "c")] and (tmp_path / "t" / "v-000000003").exists()
    spark.createDataFrame([(4, "d")], schema).write.parquet(f"file://{tmp_path}/plain/v-000000000")  # before there were partitions
    plain = store.Table(spark, f"file://{tmp_path}/plain", schema)
    assert plain.read().count() == 1
    plain.change(spark.createDataFrame([(5,)], "id long"), lambda at: at.unionByName(spark.createDataFrame([(5, "e")], schema)))
    assert sorted(map(tuple, plain.read().collect())) == [(4, "d"), (5, "e")]
    store.replace(plain, plain.read(), spark.createDataFrame([(6, "e")], schema), "name")
    assert sorted(map(tuple, plain.read().collect())) == [(4, "d"), (6, "e")]


def test_changes_equal_a_dictionary(spark, tmp_path):
    rng = random.Random(5)
    schema = spark.createDataFrame([], "id long, name string").schema
    t, held = store.Table(spark, f"file://{tmp_path}/t", schema, buckets=4), {}
    for step in range(8):
        ids = rng.sample(range(12), 3)
        rows = spark.createDataFrame([(i, f"{step}-{i}") for i in ids], schema)
        if step % 3 == 2:
            t.change(rows, lambda at, rows=rows: store.delete(at, rows, "id"))
            held = {i: n for i, n in held.items() if i not in ids}
        else:
            t.change(rows, lambda at, rows=rows: store.upsert(at, rows, "id", force=True))
            held.update({i: f"{step}-{i}" for i in ids})
        assert {r.id: r.name for r in t.read().collect()} == held


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    """Settings, gazetteer and PDF words reach the engine; mail and landed files reach its parser."""
    from rankspark import __main__ as cli

    made = []
    monkeypatch.setattr(engines.Engine, "parse_files", lambda self, at: at.drop("content").withColumn("error", F.lit("unreadable")))
    monkeypatch.setattr(cli, "Engine", lambda *a, **k: made.append((a, k)) or engines.Engine(*a, **k))
    (tmp_path / "names.txt").write_text("# companies\n\nAcme Works\n")
    (tmp_path / "s.yaml").write_text("top_k: 7\n")
    (tmp_path / "mail").mkdir()
    (tmp_path / "mail" / "1.eml").write_bytes(message("a@b", ("cv.docx", b"not a document")))
    root = f"file://{tmp_path}/root"
    cli.main(["--root", root, "--settings", str(tmp_path / "s.yaml"), "--gazetteer", str(tmp_path / "names.txt"), "--pdf-words", "os.path:basename", "mail", str(tmp_path / "mail")])
    (_, _, s), kw = made[0]
    assert s.top_k == 7 and kw["phrases"] == ("Acme Works",) and kw["pdf_words"] is __import__("os").path.basename
    assert [r.source_file for r in engines.Engine(spark, root).quarantine().collect()] == ["cv.docx"]
    cli.main(["--root", root, "ingest", str(tmp_path / "mail")])
    assert engines.Engine(spark, root).quarantine().count() == 2
    with pytest.raises(SystemExit):
        cli.main(["--root", root, "mail"])


def test_ingestion_by_content(spark, tmp_path):
    """One name with two contents gives two rows; failures go to quarantine; a replacement is one write."""
    schema = T.StructType.fromDDL("id long, source_file string, content_hash string")
    t = store.Table(spark, f"file://{tmp_path}/c", schema)
    df = lambda *rows: spark.createDataFrame(list(rows), "source_file string, content_hash string")
    parse = lambda at: at.withColumn("error", F.when(F.col("content_hash") == "bad", "unreadable"))
    got = ingest.ingest_batch(df(("cv.pdf", "a"), ("cv.pdf", "b"), ("x y.pdf", "b2"), ("z.pdf", "bad"), ("again.pdf", "a")), t, parse, named=True)
    assert got == {"pulled": 4, "parsed": 3, "errors": 1}
    rows = t.read().collect()
    assert sorted(r.id for r in rows) == [1, 2, 3] and all(r.source_file.startswith(f"{r.id}_") for r in rows)
    assert [(r.content_hash, r.error) for r in ingest.quarantine(t).collect()] == [("bad", "unreadable")]
    assert ingest.ingest_batch(df(("new.pdf", "a")), t, parse)["pulled"] == 0
    before, name = t.version(), rows[0].source_file
    ingest.ingest_batch(df((name, "fresh"), (rows[1].source_file, "bad")), t, parse, replace=True)
    assert t.version() == before + 1 and t.read().count() == 3
    assert {r.content_hash for r in t.read().collect()} == {"fresh", rows[1].content_hash, rows[2].content_hash}


def test_best_of_blocks(spark):
    """Blocks of any size give what one matrix gives, zeros and boosts included."""
    import numpy as np

    from rankspark.operators import tfidf as X

    rng = random.Random(8)
    row = lambda i: (i, sorted(rng.sample(range(12), rng.randint(0, 4))), rng.choice(["a", "b", None]), rng.choice([True, False, None]))
    rows = [(i, at, [rng.random() for _ in at], c, b) for i, at, c, b in map(row, range(60))]
    df = spark.createDataFrame(rows, "id long, at array<int>, w array<double>, category string, boosts boolean")
    dense = np.zeros((60, 12))
    for i, at, w, _, _ in rows:
        dense[i, at] = w
    q = rows[:9]
    got = X.best(df.where("id < 9"), df.repartition(5), 7).collect()
    for i, _, _, c, b in q:
        score = [dense[i] @ dense[j] + 0.1 * (c is not None and c == rows[j][3] and b is not False and rows[j][4] is not False) for j in range(60)]
        expected = sorted(range(60), key=lambda j: (-round(score[j], 9), j))[:7]
        assert [r.candidate_id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)] == expected
