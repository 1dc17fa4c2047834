import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, blanks, copies, near copies, shared passages, a long text and
    rows that repeat."""
    rng = random.Random(5)
    english = "the of and house water garden window river stone letter morning people".split()
    german = "der und das haus wasser garten fenster fluss stein brief morgen leute".split()
    french = "le et la maison eau jardin fenêtre rivière pierre lettre matin gens".split()
    spanish = "el y la casa agua jardín ventana río piedra carta mañana gente".split()
    out = []
    for i in range(80):
        lang, words = [("en", english), ("de", german), ("fr", french), ("es", spanish)][i % 4]
        out.append((i, prose(rng, words, rng.randint(3, 160)), lang, f"s{i % 5}"))
    passage = prose(rng, english, 110)
    for i in range(80, 90):
        out.append((i, prose(rng, english, 20) + "\n" + passage + "\n" + prose(rng, english, 15), "en", "s0"))
    for i in range(90, 96):
        out.append((i, out[7][1].replace(" ", "  " if i % 2 else "\t"), "es", "s1"))
    base = prose(rng, german, 150)
    for i in range(96, 104):
        w = base.split()
        w[i % 150] = "anders"
        out.append((i, " ".join(w), "de", "s2"))
    out += [(200, None, None, "s3"), (201, "", "en", None), (202, " \t\n ", None, None), (203, "12345 67890", "en", "s3"), (204, "Word", "en", "s4"), (205, "two words", "en", "s4"), (206, "É à ü", "fr", "s4"), (207, None, "de", "s3")]
    out.append((208, prose(rng, english, 6000), "en", "s0"))
    out += [out[3], out[3], (None, "without an id at all", "en", "s0"), (None, None, None, None)]
    return [(i, t, l, s, len(t) if t else 0) for i, t, l, s in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With extra columns whose names the operators use for results."""
    from pyspark.sql import functions as F

    at = spark.createDataFrame(rows, DOCS).repartition(3)
    for name in ("id", "fp", "keep_id", "kept", "part", "n", "ids", "start", "size", "target", "spans", "k1", "uid", "component_id"):
        at = at.withColumn(name, F.lit("x"))
    path = "file:///tmp/rankspark-test-docs"
    at.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
