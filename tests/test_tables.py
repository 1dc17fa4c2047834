"""Table functions in SQL against the expressions that give arrays."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankspark.functions import tables
from rankspark.functions import text as X

LINES = [
    None, "", "no date", "05/2019 - 07/2021 and March 2020", "май 2018 — по настоящее время", "2017–2018; 2019 - now; 2020", "Jan 2020 → CURRENT  time", "19/2020 13/1999", "x 2019-2020-2021", "ИЮНЬ 2011 - 2012",
    "Skills: python, sql (a, b), c++; d", "• Tools: x|y  z", "a, (b, c]], d. , e", "12-34, 2019, и, foo@bar.com, ok", "((a, b), c", "one  two,three;;", "http://x", "ё: ж",
]


def test_table_functions_equal_the_expressions(spark):
    tables.register(spark)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(LINES)], "id int, line string")
    df.createOrReplaceTempView("some_lines")
    got = sorted(map(tuple, spark.sql("SELECT id, d.pos, d.start, d.end FROM some_lines, LATERAL date_ranges(line) d").collect()), key=str)
    want = df.select("id", F.posexplode(X.date_ranges(F.col("line"))).alias("pos", "x")).select("id", "pos", "x.start", "x.end").collect()
    assert got == sorted(map(tuple, want), key=str) and len(got) > 9
    got = sorted(map(tuple, spark.sql("SELECT id, s.pos, s.item, s.noise FROM some_lines, LATERAL skill_items(line) s").collect()), key=str)
    items = df.where("line is not null").select("id", F.posexplode(X.split_items(X.skill_payload(F.col("line")))).alias("pos", "item"))
    assert got == sorted(map(tuple, items.select("id", "pos", "item", X.is_skill_noise(F.col("item"))).collect()), key=str) and len(got) > 20


def test_first_dates_is_the_first_of_all(spark):
    df = spark.createDataFrame([(t,) for t in LINES], "line string")
    at = df.select(X.first_dates(F.col("line")).alias("a"), F.get(X.date_ranges(F.col("line")), F.lit(0)).alias("b")).collect()
    assert [r.a for r in at] == [r.b for r in at] and sum(r.a is not None for r in at) > 6


@settings(max_examples=100, deadline=None)
@given(st.text("ab(,;|)[] .", max_size=20))
def test_items_hold_every_letter(text):
    assert "".join(c for item in tables.split_items(text) for c in item if c in "ab") == "".join(c for c in text if c in "ab")
