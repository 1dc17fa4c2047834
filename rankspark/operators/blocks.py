"""Exact k best of a query set against all rows, in blocks, past groups that can't matter.

Rows are packed where they are into blocks, one row of a table each; each block of queries
meets each block of candidates. A block of candidates is ordered into groups of like rows, each with
what bounds its scores. A task keeps the k best so far of the queries it has met: it takes a
block's groups from the highest bound down, and leaves out those whose bound is below the k-th best
score of every query. Only the k best of a task leave it, and what is left out could not be among
them, so the result is exact. A bounded number of queries is broadcast, and a task holds one block of
its candidates; of more, Spark takes blocks against blocks, so that neither side passes through the driver.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Scores are compared at nine places; ties go to smaller ids.
PLACES = 9


#: Candidates of a group.
GROUP = 64
_NONE = -(1 << 62)


class Best:
    """The k best so far of each of n queries, by rounded score and then by smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.key, self.ids, self.score = k, np.full((n, k), _NONE), np.zeros((n, k), np.int64), np.zeros((n, k))

    def floor(self) -> np.ndarray:
        return self.key[:, -1]

    def add(self, asked: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Scores of the queries ``asked`` with the candidates ``ids``."""
        key = np.rint(score * 10.0**PLACES).astype(np.int64)
        near = (key >= self.floor()[asked, None]).any(axis=1)
        own = asked[near]
        if not len(own):
            return
        key = np.concatenate([self.key[own], key[near]], axis=1)
        ids = np.concatenate([self.ids[own], np.broadcast_to(ids, (len(own), len(ids)))], axis=1)
        score = np.concatenate([self.score[own], score[near]], axis=1)
        by = np.lexsort((ids, -key), axis=1)[:, : self.k]
        self.key[own], self.ids[own], self.score[own] = (np.take_along_axis(x, by, axis=1) for x in (key, ids, score))


def visit(best: Best, groups: list[np.ndarray], bound: np.ndarray, score: Callable) -> int:
    """Adds what the groups (ids of each) have. bound: no score of a query (row) with a group
    (column) is above it. score: (queries, group) -> matrix. Returns the pairs of query and group scored."""
    most, met = np.rint(bound * 10.0**PLACES).astype(np.int64) + 1, 0
    left = np.ones(bound.shape, bool)

    def take(asked, g):
        nonlocal met
        best.add(asked, groups[g], score(asked, g))
        left[asked, g] = False
        met += len(asked)

    # each query's own best group first: it gives a good floor
    first = most.argmax(axis=1)
    for g in np.unique(first).tolist():
        take(np.flatnonzero((first == g) & (most[:, g] >= best.floor())), g)
    for g in np.argsort(-most.max(axis=0), kind="stable").tolist():
        asked = np.flatnonzero(left[:, g] & (most[:, g] >= best.floor()))
        if len(asked):
            take(asked, g)
    return met


#: Bytes of files whose rows a task gets from spread(): a task's time doesn't grow with the table.
TASK_BYTES = 4 << 20


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt evenly where they come from few files, whose rows may lie in one group that can't be
    split: to the cores, or to more tasks where the files are large. Only the files' lengths are read for this."""
    spark, files = rows.sparkSession, rows.inputFiles()
    cores = spark.sparkContext.defaultParallelism
    paths = [re.sub(r"([][{}*?\\])", r"\\\1", unquote(f)) for f in files]
    size = spark.read.format("binaryFile").load(paths).agg(F.sum("length")).first()[0] if files else 0
    tasks = max(cores, -(-(size or 0) // TASK_BYTES))
    return rows.repartition(tasks) if len(files) < max(2 * cores, tasks) else rows


def pieces(batch: pa.RecordBatch, column: int, at_most: int):
    """Rows of an Arrow batch in parts whose lists in the column have at_most elements in all, or one row."""
    size = pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, i = np.cumsum(size), 0
    while i < len(batch):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + at_most, "right")))
        yield batch.slice(i, j - i)
        i = j


def packed(rows: DataFrame, pack: Callable, columns: str, at_most: int, gather: bool = False) -> DataFrame:
    """Blocks of ``rows``: ``pack`` turns an Arrow table of up to ``at_most`` rows into blocks, each
    the values of ``columns``. gather: as few blocks as can be, for queries."""
    if gather:
        rows = rows.repartition(max(1, -(-rows.count() // at_most)))

    arrow = to_arrow_schema(StructType.fromDDL(columns))

    def run(batches):
        for values in _blocks(batches, pack, at_most):
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, values))], arrow)

    return rows.mapInArrow(run, columns)


def _blocks(batches, pack: Callable, at_most: int):
    held, n = [], 0
    for batch in batches:
        for i in range(0, len(batch), at_most):
            part = batch.slice(i, at_most)
            if n + len(part) > at_most:
                yield from pack(pa.Table.from_batches(held))
                held, n = [], 0
            held.append(part)
            n += len(part)
    if held:
        yield from pack(pa.Table.from_batches(held))


def pairs(queries: DataFrame, candidates: DataFrame, pack: Callable, columns: str, at_most: int, few: bool, meet: Callable, k: int, counts: tuple | None = None) -> DataFrame:
    """(query_id, candidate_id, score) of the k best of each task. queries: blocks, as packed() has them;
    candidates: rows, which ``pack`` turns into blocks of ``columns``. ``meet`` makes of a block of each
    (dicts) the query ids and what visit() takes, or None. few: whether all blocks of queries go to every
    task, which then makes one block of its candidates at a time and keeps none; blocks of more queries
    meet blocks in a join. counts: two accumulators, of all pairs of a query and a group, and of those scored."""
    kinds = "query_id bigint, candidate_id bigint, score double"

    def best_of(met):
        held: dict = {}
        for q, c in met:
            got = meet(q, c)
            if got is None or not got[2].size:
                continue
            asked, groups, bound, score = got
            best = held.setdefault(asked.tobytes(), (asked, Best(len(asked), k)))[1]
            scored = visit(best, groups, bound, score)
            if counts:
                counts[0].add(bound.size)
                counts[1].add(scored)
        for asked, best in held.values():
            at, place = np.nonzero(best.key > _NONE)
            yield pa.RecordBatch.from_arrays([pa.array(asked[at], pa.int64()), pa.array(best.ids[at, place], pa.int64()), pa.array(best.score[at, place], pa.float64())], ["query_id", "candidate_id", "score"])

    if few:
        names = [f.name for f in StructType.fromDDL(columns).fields]
        shared = queries.sparkSession.sparkContext.broadcast([r.asDict() for r in queries.collect()])

        def run(batches):
            yield from best_of((q, c) for values in _blocks(batches, pack, at_most) for c in [dict(zip(names, values))] for q in shared.value)

        return candidates.mapInArrow(run, kinds)
    q, c = (df.select(F.struct(*df.columns).alias(n)) for df, n in ((queries, "q"), (packed(candidates, pack, columns, at_most), "c")))

    def run_joined(batches):
        rows = (batch.slice(i, 1).to_pylist()[0] for batch in batches for i in range(len(batch)))
        yield from best_of((row["q"], row["c"]) for row in rows)

    return c.crossJoin(q).mapInArrow(run_joined, kinds)
