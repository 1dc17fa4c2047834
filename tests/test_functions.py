"""Column expressions against crafted rows."""

import pytest
from pyspark.sql import functions as F

from rankspark.functions import text as X
from rankspark.functions import vector as V


@pytest.fixture
def ev(spark):
    def run(f, *values, kind="string"):
        df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} {kind}" for i in range(len(values))))
        return df.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("r")).first().r

    return run


@pytest.mark.parametrize("text, expected", [("mail a.b+c@x-y.co.uk now", "a.b+c@x-y.co.uk"), ("none here", None), ("a@b.c", None), ("first x@y.kz then z@w.ru", "x@y.kz")])
def test_email(ev, text, expected):
    assert ev(X.email, text) == expected


@pytest.mark.parametrize("text, expected", [("call +7 (701) 123-45-67 now", "+7 (701) 123-45-67"), ("12345", None), ("1234567890123456 and 8 701 123 45 67", "8 701 123 45 67"), ("ids 1234567890123456x 87011234567", "87011234567"), ("", None)])
def test_phone(ev, text, expected):
    assert ev(X.phone, text) == expected


@pytest.mark.parametrize("text, expected", [("абв abc", ["ru", "en"]), ("12345", []), ("привет", ["ru"]), ("hello", ["en"]), ("я" + "a" * 19, ["en"]), ("ёё" + "a" * 30, ["ru", "en"])])
def test_languages(ev, text, expected):
    assert ev(X.languages, text) == expected


def test_is_russian(ev):
    assert ev(X.is_russian, "Навыки") and not ev(X.is_russian, "skills")


@pytest.mark.parametrize("text, expected", [("Иван Петров", "Иван Петров"), ("IVAN PETROV", "IVAN PETROV"), ("Ivan PETROV", None), ("Ivan", None), ("Анна-Мария Ли", "Анна-Мария Ли"), ("A Petrov", None), ("Ivan Petrov Jr. Extra", None), ("Ivan Petrov 2", None), ("", None)])
def test_names(ev, text, expected):
    assert ev(X.valid_name, text) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Jun 2025 - Current Time", [("Jun 2025", "present")]),
        ("BSc, 2019", [(None, "2019")]),
        ("2015 then 2018 - 2020", [("2018", "2020"), (None, "2015")]),
        ("Январь 2020 — по настоящее время", [("Январь 2020", "present")]),
        ("03/2019–11.2021", [("03/2019", "11.2021")]),
        ("no dates", []),
        ("2018 → NOW", [("2018", "present")]),
    ],
)
def test_dates(ev, text, expected):
    assert [tuple(r) for r in ev(X.date_ranges, text)] == expected


@pytest.mark.parametrize("text, expected", [("Middle ML/AI Engineer Jun 2025 - Current Time", "Middle ML/AI Engineer"), ("2019 — 2020: Dev, 2021", "Dev"), ("VBox", "VBox")])
def test_without_dates(ev, text, expected):
    assert ev(X.without_dates, text) == expected


@pytest.mark.parametrize("text, expected", [("Ryte.AI", True), ("VBox", True), ("Backend Инженер", False), ("AI", False), ("vbox", False), ("X.AI Labs", True), ("A" * 21, False), ("", False)])
def test_looks_like_org(ev, text, expected):
    assert ev(X.looks_like_org, text) is expected


def test_org_in_line(spark):
    df = spark.createDataFrame([("Work at Nazarbayev University, ML", ["ML", "nazarbayev university", "Work"])], "t string, o array<string>")
    assert df.select(X.org_in_line(F.col("t"), F.col("o")).alias("r")).first().r == "nazarbayev university"
    assert df.select(X.org_in_line(F.lit("Workshops"), F.col("o")).alias("r")).first().r is None


@pytest.mark.parametrize(
    "text, expected",
    [
        ("• Языки: Python (FastAPI, Django), SQL, 2020", ["Python (FastAPI, Django)", "SQL", "2020"]),
        ("a; b | c", ["a", "b", "c"]),
        ("one  two,three.", ["one", "two", "three"]),
        ("x [a, b), c", ["x [a, b)", "c"]),
        ("", []),
    ],
)
def test_split_items(ev, text, expected):
    assert ev(lambda c: X.split_items(X.skill_payload(c)), text) == expected


@pytest.mark.parametrize("text, noise", [("Python", False), ("C", True), ("2020", True), ("12 34", True), ("and", True), ("и т.д.", True), ("me@gmail", True), ("x" * 61, True), ("C#", False)])
def test_skill_noise(ev, text, noise):
    assert ev(X.is_skill_noise, text) is noise


@pytest.mark.parametrize("text, junk", [("deep learning", False), ("ai", True), ("2020", True), ("12-34 x", True), ("708 669", True), ("Developed", True), ("www site", True)])
def test_junk_phrases(ev, text, junk):
    assert ev(X.is_junk_phrase, text) is junk


def test_dominated(ev):
    assert ev(X.dominated_by, "ivan petrov", "Ivan Petrov") and ev(X.dominated_by, "ivan python", "Ivan P")
    assert not ev(X.dominated_by, "python sql ivan", "Ivan") and not ev(X.dominated_by, "x", None)


@pytest.mark.parametrize("name, expected", [("/a/b/My CV (1).PDF", "My_CV__1_.pdf"), ("Резюме Иван.DOCX", "Резюме_Иван.docx"), (".bashrc", ".bashrc"), ("", "uploaded.bin"), ("a.b.C", "a.b.c"), ("x y", "x_y")])
def test_sanitize(ev, name, expected):
    assert ev(X.sanitize_filename, name) == expected


def test_labels_and_formats(ev):
    assert ev(X.source_to_category, "3_information_technology.json") == "INFORMATION-TECHNOLOGY"
    assert ev(X.score_bar, 0.5, kind="double") == "●●○○○  0.50"
    assert ev(X.score_bar, 9.0, kind="double") == "●●●●●  9.00"
    assert ev(X.clamp01, None, kind="double") is None
    assert ev(X.clamp01, 1.5, kind="double") == 1.0 and ev(X.clamp01, -1.0, kind="double") == 0.0
    assert ev(X.excerpt, "a" * 3001) == "a" * 3000 + "… [truncated]" and ev(X.excerpt, "a" * 3000) == "a" * 3000
    assert ev(X.final_name, "7", "a b.PDF") == "7_a_b.pdf"
    assert ev(X.strip, " \t x  ") == "x"
    assert ev(X.vacancy_text, "", "d") == "d" and ev(X.vacancy_text, "t", "d") == "t\n\nd"


def test_numbers_are_rounded_from_their_exact_value(spark):
    """As C's printf does: 0.2985 and 0.9325 are doubles below the half, 0.0625 is one exactly."""
    rows = [(x,) for x in (0.2985, 0.9325, 0.1245, 0.0625, 0.1875, 1234567.1255, -0.0001, 0.3)]
    got = spark.createDataFrame(rows, "x double").select("x", X.match_line(F.lit(1), F.col("x"), F.lit("n"), F.lit("m"), F.lit("a/b")).alias("line")).collect()
    assert [r.line for r in got] == ["  1. (%.3f) n <m>  b" % r.x for r in got]
    bar = spark.createDataFrame([(0.145,), (0.125,), (0.285,)], "x double").select("x", X.score_bar(F.col("x")).alias("bar")).collect()
    assert [r.bar.split("  ")[1] for r in bar] == ["%.2f" % r.x for r in bar]


def test_letters_of_each_alphabet_are_counted_once(spark):
    texts = ["", "123 !?", "Иван ivan", "a" * 95 + "я" * 5, "a" * 94 + "я" * 6, "ё" * 95 + "b" * 5, "é ü ß", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(X.languages(F.col("text")).alias("found"))
    assert [r.found for r in df.collect()] == [[], [], ["ru", "en"], ["en"], ["ru", "en"], ["ru"], [], []]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 2 and "regexp_extract_all" not in plan and "regexp_count" not in plan


def test_numbers_below_the_last_place_are_rounded_from_their_exact_value(spark):
    """0.0005 and 0.005 are doubles above the half; format_number() gives 0.000 and 0.00."""
    rows = [(x,) for x in (0.0005, 0.00049999, 0.0015, 0.005, 1e300, 2.0**60 + 256, 1e-300, -0.0, float("nan"), float("inf"), None)]
    got = spark.createDataFrame(rows, "x double").select("x", X.fixed(F.col("x"), 3).alias("three"), X.fixed(F.col("x"), 2).alias("two")).collect()
    assert [(r.three, r.two) for r in got[:-1]] == [("%.3f" % r.x, "%.2f" % r.x) for r in got[:-1]] and got[-1].three is None
    assert got[0].three == "0.001" and got[3].two == "0.01"


def test_match_lines_equal_their_sql(spark, tmp_path):
    """Balances of 5 give scores of 0.0005; printf of a null is null."""
    duckdb = pytest.importorskip("duckdb")
    from rankspark.plans import catalogue

    rows = [(1, "a", 1, 5.0, "X"), (2, "b", 2, -5.0, "BUILDING"), (3, "c", 3, 15.0, None), (4, None, 4, 2985.0, "X"), (5, "e", None, 1.0, "X"), (6, "f", 6, None, "X"), (None, "g", 7, 1.0, "X")]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    with duckdb.connect() as own:
        own.execute(f"CREATE VIEW customer AS FROM '{tmp_path}/customer.parquet/*.parquet'")
        expected = own.execute(catalogue.SQL["match_lines"]).fetchall()
    got = [tuple(r) for r in catalogue.match_lines(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str) and "(0.001)" in dict(got)[1]


@pytest.mark.parametrize(
    "answer, expected",
    [
        ('noise {"score": 1.7, "explanation": "ok"} tail', (1.0, "ok")),
        ('{"score": 0.3, "explanation": "fits"}', (0.3, "fits")),
        ("not json", None),
        ('{"score": null, "explanation": "x"}', None),
        ('{"score": 0.5, "explanation": ""}', None),
        ('{"score": 0.5, "explanation": "' + "x" * 601 + '"}', None),
        (None, None),
    ],
)
def test_parsed_score(ev, answer, expected):
    got = ev(X.parsed_score, answer)
    assert (tuple(got) if got else None) == expected


def test_cosine(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    r = df.select(V.cosine(F.col("a"), F.col("b")).alias("x"), V.cosine(F.col("a"), F.col("z")).alias("y")).first()
    assert r.x == pytest.approx(0.96) and r.y is None


