"""Asking a scorer about pairs: limits, retries, failures of single pairs."""

import asyncio
import threading
import time

import pytest
from pyspark.sql import functions as F

from rankspark.operators import ranking, scoring

PAIRS = "query_id long, candidate_id long, system string, prompt string"


def asked(calls, scorer, gate=5):
    async def run():
        limit = asyncio.Semaphore(gate)
        return await asyncio.gather(*(scoring.answer_one(scorer, scorer.call, limit, "s", c) for c in calls))

    return asyncio.run(run())


@pytest.mark.parametrize("plain", [True, False])
def test_calls_in_flight_are_bounded(plain):
    lock, now, most = threading.Lock(), [0], [0]

    def enter(by):
        with lock:
            now[0] += by
            most[0] = max(most[0], now[0])

    def call(system, prompt):
        enter(1)
        time.sleep(0.01)
        enter(-1)
        return prompt

    async def call_async(system, prompt):
        enter(1)
        await asyncio.sleep(0.01)
        enter(-1)
        return prompt

    calls = [str(i) for i in range(40)]
    assert asked(calls, scoring.Scorer(call if plain else call_async), 3) == [(c, None, 1) for c in calls]
    assert most[0] == 3


def test_retries_stop_and_pairs_fail_alone():
    tries = {}

    async def call(system, prompt):
        tries[prompt] = tries.get(prompt, 0) + 1
        if prompt == "never" or prompt == "later" and tries[prompt] < 3:
            raise ConnectionError("down")
        if prompt == "refused":
            raise scoring.Refused("no")
        if prompt == "slow":
            await asyncio.sleep(9)
        return prompt

    scorer = scoring.Scorer(call, retries=2, backoff_s=0.001, timeout_s=0.05)
    got = dict(zip(("never", "later", "refused", "slow", "fine"), asked(["never", "later", "refused", "slow", "fine"], scorer)))
    assert got["never"] == (None, "ConnectionError: down", 3) and got["later"] == ("later", None, 3) and got["fine"] == ("fine", None, 1)
    assert got["refused"] == (None, "Refused: no", 1) and got["slow"][0] is None and got["slow"][1].startswith("TimeoutError") and got["slow"][2] == 3


def test_a_plain_call_that_hangs_is_left():
    began = time.monotonic()
    assert asked(["x"], scoring.Scorer(lambda s, p: time.sleep(3), retries=0, timeout_s=0.05))[0][1].startswith("TimeoutError")
    assert time.monotonic() - began < 2


def test_pauses_grow_and_are_bounded():
    scorer = scoring.Scorer(lambda s, p: p, backoff_s=1.0, longest_backoff_s=4.0)
    pauses = [scoring.pause(scorer, "p", i) for i in range(6)]
    assert all(0.5 * min(2**i, 4) <= p <= min(2**i, 4) for i, p in enumerate(pauses)) and pauses == [scoring.pause(scorer, "p", i) for i in range(6)]


def test_settings_are_checked():
    for wrong in ({}, {"call": print, "open": print}, {"call": print, "concurrent": 0}, {"call": print, "timeout_s": 0}):
        with pytest.raises(ValueError):
            scoring.Scorer(**wrong)
    for wrong in ({"system_en": "short"}, {"user": "{title} and {nonsense} of a pair"}):
        with pytest.raises(ValueError):
            scoring.Prompts(**wrong)


def test_ask_keeps_columns_and_rows(spark):
    def call(system, prompt):
        if prompt == "bad":
            raise ValueError("broken")
        return f"{system}:{prompt}"

    rows = [(1, 1, "a", "x"), (1, 2, "b", "bad"), (2, 1, None, None), (None, None, "c", ""), (1, 1, "a", "x")]
    df = spark.createDataFrame(rows, PAIRS).withColumn("extra", F.array(F.lit(1)))
    got = scoring.asked_once(df, scoring.Scorer(call, retries=1, backoff_s=0.001))
    assert got.columns == ["query_id", "candidate_id", "extra", "answer", "error", "attempts"]
    found = sorted((str(r.query_id), r.candidate_id or 0, r.answer, r.error, r.attempts) for r in got.collect())
    assert found == sorted([("1", 1, "a:x", None, 1)] * 2 + [("1", 2, None, "ValueError: broken", 2), ("2", 1, None, "no prompt", 0), ("None", 0, "c:", None, 1)], key=str)
    assert scoring.report(got).first().asDict() == {"pairs": 5, "answered": 3, "failed": 2, "retried": 1, "most_attempts": 2}
    assert scoring.ask(df.where("false"), scoring.Scorer(call)).count() == 0


def test_answers_are_asked_for_once(spark, tmp_path):
    log = str(tmp_path / "calls")

    def call(system, prompt):
        with open(log, "a") as f:
            f.write("x\n")
        return '{"score": 0.5, "explanation": "fits"}'

    short = spark.createDataFrame([(1, 1, 1, 0.4), (1, 2, 2, 0.3)], "query_id long, candidate_id long, rank int, score double")
    q = spark.createDataFrame([(1, "a query")], "query_id long, query_text string")
    c = spark.createDataFrame([(1, "text"), (2, None)], "candidate_id long, raw_text string")
    got = ranking.rerank(short, q, c, 5, scoring.Scorer(call))
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [(1, 1, 1, 0.5, "fits"), (1, 2, 2, 0.5, "fits")]
    assert got.count() == 2 and open(log).read().count("x") == 2


def test_one_opened_client_serves_a_worker(spark, tmp_path):
    log = str(tmp_path / "opened")

    def make():
        with open(log, "a") as f:
            f.write("x\n")
        return lambda system, prompt: prompt

    df = spark.range(400).selectExpr("id as query_id", "id as candidate_id", "'s' as system", "string(id) as prompt")
    assert scoring.ask(df, scoring.Scorer(open=make, tasks=2)).where("answer = string(query_id)").count() == 400
    assert open(log).read().count("x") <= 2


def test_prompts_by_language_and_template(spark, tmp_path):
    (tmp_path / "p.yaml").write_text("system_en: Compare them and answer with JSON.\nsystem_ru: Сравните их и ответьте JSON.\nuser: 'Title {title} text {raw_text} by {name}'\n", encoding="utf-8")
    prompts = scoring.Prompts.load(str(tmp_path / "p.yaml"))
    df = spark.createDataFrame([(1, "Chef", "Cook meals", "Ann", "I cook"), (2, "Повар", "Готовить", None, None)], "query_id int, title string, description string, name string, raw_text string")
    got = ranking.with_prompts(df, prompts).orderBy("query_id").collect()
    assert [(r.system, r.prompt) for r in got] == [(prompts.system_en, "Title Chef text I cook by Ann"), (prompts.system_ru, "Title Повар text  by ")]
    assert "Cook meals" in ranking.with_prompts(df, scoring.Prompts()).orderBy("query_id").first().prompt
