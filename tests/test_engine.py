"""Evaluation on the labelled set, boosts compared, scoring in the engine, progress of runs."""

import time

import pytest
from pyspark.sql import functions as F

from rankspark.config import Settings
from rankspark.operators import scoring
from rankspark.plans import engine as engines
from rankspark.streaming import ingest

LABELLED = [("python sql models data", "IT"), ("python data spark", "IT"), ("law court judge", "LAW"), ("court law contract", "LAW"), ("python contract", "LAW")]


@pytest.fixture
def engine(spark, tmp_path):
    (tmp_path / "r.csv").write_text("ID,Resume_str,Category\n" + "".join(f"{i},{t},{c}\n" for i, (t, c) in enumerate(LABELLED)))
    e = engines.Engine(spark, f"file://{tmp_path}/root", Settings(embedding_dim=64, min_df=1, ingest_retries=1, ingest_wait_s=0.0))
    e.import_labelled(str(tmp_path / "r.csv"))
    e.create_vacancy("Developer", "python data", source_filename="1_it.json")
    e.create_vacancy("Lawyer", "law court zebra", source_filename="2_law.json")
    return e


def test_the_labelled_set_has_a_fit_of_its_own(engine):
    own, every = ({r.term for r in engine._fit(s)[0].select("term").collect()} for s in ("eval", "production"))
    assert "zebra" in every and "zebra" not in own and "python" in own
    assert engine._fit("eval") is engine._fit("eval")


def test_boosts_are_compared(engine):
    got = engine.compare_boost().collect()
    assert [r.metric for r in got] == ["p_at_1", "p_at_3", "p_at_5", "p_at_10", "mrr", "ndcg_5"]
    without, boosted = (engine.evaluation("tfidf", boost=b) for b in (0.0, None))
    for r in got:
        a, b = (x.averages.first()[r.metric] for x in (without, boosted))
        assert (r.without, r.with_boost) == (a, b) and r.delta == pytest.approx(b - a) and (r.percent is None) == (a == 0)


def test_examples_say_what_was_found(engine):
    got = engine.evaluation("tfidf", examples=2).examples.collect()
    assert [(r.query_id, r["rank"]) for r in got] == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert all(r.hit == (r.category == r.found_category) and r.explanation is None for r in got) and got[0].title == "Developer" and got[0].hit
    assert engine.evaluation("tfidf", subset=1).per_query.count() == 1


def test_the_engine_asks_a_scorer_once_for_each_pair(spark, tmp_path, engine):
    log = str(tmp_path / "asked")

    def call(system, prompt):
        with open(log, "a") as f:
            f.write("x\n")
        if "judge" in prompt:
            raise scoring.Refused("no")
        return '{"score": 0.9, "explanation": "read"}' if "spark" in prompt else "?"

    e = engines.Engine(spark, engine.root, engine.settings, scorer=call)
    assert (e.scorer.retries, e.scorer.concurrent) == (3, 5)
    got = e.evaluation("llm", retriever="tfidf")
    assert got.averages.count() == 1
    first = got.examples.where("query_id = 1 and rank = 1").first()
    assert (first.explanation, round(first.score, 2), first.candidate_id) == ("read", 0.9, 2)
    assert got.examples.where("explanation is null").count() == 8
    assert open(log).read().count("x") == 2 * len(LABELLED)


def test_addresses_and_their_candidates(spark, engine):
    e = engines.Engine(spark, engine.root, Settings(embedding_dim=64, listed_ids=2))
    rows = e.candidates.read().withColumn("email", F.when(F.col("id") <= 3, "a@b.kz"))
    e.candidates.write(rows)
    assert [(r.email, r.n, r.ids) for r in e.by_email().collect()] == [("a@b.kz", 3, [1, 2]), (None, 2, [])]


def until(check, seconds=30):
    end = time.monotonic() + seconds
    while not check() and time.monotonic() < end:
        time.sleep(0.2)
    assert check()


def test_a_new_engine_knows_how_a_run_ended(spark, tmp_path, engine, monkeypatch):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "a.docx").write_bytes(b"no zip")
    assert engine.status() == {"active": False} and engine.runs().count() == 0
    engine.ingest_to_the_end(f"file://{inbox}")
    other = engines.Engine(spark, engine.root, engine.settings)
    until(lambda: other.runs().where("kind = 'ended'").count() == 1)
    got = other.status()
    assert not got["active"] and got["error"] is None and got["rows"] >= 1 and got["batches"] == 1 and '"runId"' in got["progress"]

    def broken(*a, **b):
        raise RuntimeError("disk is full")

    monkeypatch.setattr(ingest, "ingest_batch", broken)
    (inbox / "b.docx").write_bytes(b"neither")
    with pytest.raises(Exception, match="disk is full"):
        engine.ingest_to_the_end(f"file://{inbox}")
    until(lambda: other.runs().where("kind = 'failed'").count() == 2)  # one retry
    assert "disk is full" in other.status()["error"]
    spark.streams.removeListener(engine._log)


def test_polling_goes_on_until_it_is_stopped(spark, tmp_path, engine):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    assert engine.ingest_polling(f"file://{inbox}") == engine.status()["id"] and engine.status()["active"]
    engine._query.stop()
    assert not engine.status()["active"]
    spark.streams.removeListener(engine._log)


def test_the_least_name_of_a_content_stays(spark):
    rows = [("b", "h1", b"1"), ("a", "h1", b"1"), ("a", "h1", b"1"), ("c", "h2", b"2"), (None, "h3", b"3"), (None, "h3", b"3"), ("x", None, None)]
    at = spark.createDataFrame(rows, "source_file string, content_hash string, content binary").repartition(4)
    got = sorted(((r.content_hash, r.source_file, bytes(r.content)) for r in ingest.distinct_contents(at).collect()), key=str)
    assert got == [("h1", "a", b"1"), ("h2", "c", b"2"), ("h3", None, b"3")]
