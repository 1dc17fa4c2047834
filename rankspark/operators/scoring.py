"""Asking a scorer, such as a model behind a service, about many pairs from inside tasks.

Pairs are dealt to a stated number of tasks; each asks about its own, a stated number at once,
so that tasks times calls bounds what the service sees. Every call has a time limit and is tried
again after a growing pause; a pair that fails in the end has no answer and a reason, and stops
neither its task nor the others.
"""

from __future__ import annotations

import asyncio
import inspect
import re
import sys
import threading
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.text import is_russian
from . import scratch

#: Pairs whose answers a task holds at once, for each call it may have in flight.
HELD = 64


class Refused(Exception):
    """Raised by a scorer where asking again is of no use."""


@dataclass(frozen=True)
class Scorer:
    """call: (system, prompt) -> answer, a function or a coroutine function. open: makes ``call`` once
    for each Python worker instead, for what can't be sent to one, such as a client. A synchronous
    call can't be cancelled: past its time limit the task goes on, while its thread may still run."""

    call: Callable | None = None
    open: Callable | None = None
    concurrent: int = 5
    tasks: int = 4
    timeout_s: float = 60.0
    retries: int = 3
    backoff_s: float = 1.0
    longest_backoff_s: float = 30.0

    def __post_init__(self):
        if (self.call is None) == (self.open is None):
            raise ValueError("give exactly one of call and open")
        if min(self.concurrent, self.tasks) < 1 or self.retries < 0 or self.timeout_s <= 0:
            raise ValueError("concurrent and tasks start at 1, retries at 0, and a time limit is above 0")


@dataclass(frozen=True)
class Prompts:
    """What a scorer is told, in the language of the query; ``user`` is a template of a pair's
    {fields}, None for functions.text.prompt."""

    system_en: str = 'You compare a vacancy with a candidate. Answer with JSON only: {"score": number from 0 to 1, "explanation": up to 60 words in English}.'
    system_ru: str = 'Вы сравниваете вакансию с кандидатом. Ответ - только JSON: {"score": число от 0 до 1, "explanation": до 60 слов по-русски}.'
    user: str | None = None
    fields: frozenset = field(default=frozenset(("title", "description", "name", "languages", "skills", "experience", "education", "raw_text")), init=False, repr=False)

    def __post_init__(self):
        for text in (self.system_en, self.system_ru, *([] if self.user is None else [self.user])):
            if len(text) < 20:
                raise ValueError("a prompt has 20 characters at least")
        unknown = set(re.findall(r"\{(\w+)\}", self.user or "")) - self.fields
        if unknown:
            raise ValueError(f"unknown fields: {sorted(unknown)}")

    @classmethod
    def load(cls, path: str) -> "Prompts":
        import yaml

        with open(path, encoding="utf-8") as f:
            return cls(**(yaml.safe_load(f) or {}))

    def system(self, query: Column) -> Column:
        return F.when(is_russian(query), self.system_ru).otherwise(self.system_en)


def filled(template: str, values: dict[str, Column]) -> Column:
    """The template with its {fields} replaced; null values become the empty text."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(values[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def pause(scorer: Scorer, prompt: str, attempt: int) -> float:
    """Seconds before another attempt: doubled each time, up to the longest, and spread by a hash."""
    spread = zlib.crc32(f"{attempt}:{prompt}".encode()) / (1 << 32)
    return min(scorer.backoff_s * 2**attempt, scorer.longest_backoff_s) * (0.5 + 0.5 * spread)


def _in_thread(call: Callable, *given):
    """A future of call(*given), run in a thread of its own."""
    loop = asyncio.get_running_loop()
    done = loop.create_future()

    def finish(value, error):
        if not done.done():
            done.set_result(value) if error is None else done.set_exception(error)

    def run():
        try:
            got = call(*given), None
        except Exception as why:
            got = None, why
        try:
            loop.call_soon_threadsafe(finish, *got)
        except RuntimeError:  # the task has ended since
            pass

    threading.Thread(target=run, daemon=True).start()
    return done


async def answer_one(scorer: Scorer, call: Callable, gate: asyncio.Semaphore, system: str | None, prompt: str | None) -> tuple:
    """(answer, error, attempts) of a pair; nothing it does raises."""
    if prompt is None:
        return None, "no prompt", 0
    error = None
    for attempt in range(scorer.retries + 1):
        try:
            async with gate:
                begun = call(system, prompt) if inspect.iscoroutinefunction(call) else _in_thread(call, system, prompt)
                got = await asyncio.wait_for(begun, scorer.timeout_s)
            return None if got is None else str(got), None, attempt + 1
        except Exception as why:
            error = f"{type(why).__name__}: {str(why)[:200]}"
            if isinstance(why, Refused):
                break
        if attempt < scorer.retries:
            await asyncio.sleep(pause(scorer, prompt, attempt))
    return None, error, attempt + 1


def _opened(scorer: Scorer) -> Callable:
    if scorer.call:
        return scorer.call
    kept = sys.__dict__.setdefault("_rankspark_scorers", {})
    key = getattr(scorer.open, "__module__", ""), getattr(scorer.open, "__qualname__", repr(scorer.open))
    if key not in kept:
        kept[key] = scorer.open()
    return kept[key]


def ask(pairs: DataFrame, scorer: Scorer) -> DataFrame:
    """``pairs`` without its columns system and prompt, and with answer, error and attempts.

    A task that is lost asks about its pairs again; write the result before it is used twice.
    """
    keys = [f for f in pairs.schema if f.name not in ("system", "prompt")]
    out = StructType([*keys, StructField("answer", StringType()), StructField("error", StringType()), StructField("attempts", IntegerType())])
    arrow, names = to_arrow_schema(out), [f.name for f in keys]

    def run(batches):
        call = _opened(scorer)

        async def all_of(systems, prompts):
            gate = asyncio.Semaphore(scorer.concurrent)
            return await asyncio.gather(*(answer_one(scorer, call, gate, s, p) for s, p in zip(systems, prompts)))

        with asyncio.Runner() as runner:
            for batch in batches:
                for at in range(0, len(batch), HELD * scorer.concurrent):
                    part = batch.slice(at, HELD * scorer.concurrent)
                    found = runner.run(all_of(part.column("system").to_pylist(), part.column("prompt").to_pylist()))
                    columns = [part.column(n) for n in names] + [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32()))]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    by = [F.xxhash64(*[f.name for f in keys])] if keys else []
    return pairs.repartition(scorer.tasks, *by).mapInArrow(run, out)


def asked_once(pairs: DataFrame, scorer: Scorer) -> DataFrame:
    """ask(), written to the shared folder, so that no pair is asked about twice."""
    path = scratch.folder(pairs.sparkSession, "answers")
    got = ask(pairs, scorer)
    got.write.parquet(path)
    return pairs.sparkSession.read.schema(got.schema).parquet(path)


def report(answers: DataFrame) -> DataFrame:
    """One row: pairs, answered, failed, retried, and the most attempts of a pair."""
    return answers.agg(
        F.count(F.lit(1)).alias("pairs"), F.count("answer").alias("answered"), F.count("error").alias("failed"), F.count_if(F.col("attempts") > 1).alias("retried"), F.max("attempts").alias("most_attempts"),
    )
