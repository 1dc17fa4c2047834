"""The most frequent terms of a corpus, exact, without a shuffle of all its terms.

The texts are read once. Tasks write the counts of their terms, add them to a count-min sketch, and
keep counts of some of their frequent terms. Summed over the tasks, a term's cells give an upper bound
of its count, and its kept counts a lower bound. The n-th highest lower bound is a floor: n terms reach it
for certain, so a term whose upper bound is below it can't be one of the n. Of the written counts, only
those of the other terms shuffle.

Defined results: a word has no space; a null list of words has no terms; equal counts go by the term; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, scratch

#: Words whose counts a task holds at once, before it writes them; a longer text is taken alone.
HELD_WORDS = 1 << 19
#: Rows of the sketch, each with a hash of its own, and the most cells of a row: 24 MB in all.
DEPTH, MOST_CELLS = 3, 1 << 20
#: Cells that travel as one row of a table, and the groups in which tasks' blocks are summed first.
BLOCK_CELLS, GROUPS = 1 << 12, 64


def width(n: int) -> int:
    """Cells in a row of the sketch for the n most frequent terms: a power of two, 32 for each term or more."""
    return min(MOST_CELLS, max(BLOCK_CELLS, 1 << (32 * n - 1).bit_length()))


def _powers(n: int) -> np.ndarray:
    """B^0 to B^(n-1), modulo 2^64."""
    factors = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


def _codes(terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64 bits and the length of each string: its bytes as digits, so that a pair's bits come from its words'."""
    ends = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset : terms.offset + len(terms) + 1].astype(np.int64)
    size = np.diff(ends)
    digits = np.frombuffer(terms.buffers()[2], np.uint8)[ends[0] : ends[-1]].astype(np.uint64) + np.uint64(1) if size.any() else np.zeros(0, np.uint64)
    ends = ends - ends[0]
    digits *= _powers(int(size.max(initial=0)) + 1)[np.repeat(ends[1:], size) - 1 - np.arange(len(digits))]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(digits, dtype=np.uint64)])
    return total[ends[1:]] - total[ends[:-1]], size


def _joined(a: tuple, b: tuple) -> np.ndarray:
    """The bits of "a b"."""
    power = _powers(int(b[1].max(initial=0)) + 2)
    return a[0] * power[b[1] + 1] + np.uint64(ord(" ") + 1) * power[b[1]] + b[0]


def _cells(h: np.ndarray, cells: int) -> np.ndarray:
    for _ in range(2):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    return np.stack([((h >> np.uint64(20 * i)) & np.uint64(cells - 1)).astype(np.int64) for i in range(DEPTH)])


def places(terms, cells: int) -> np.ndarray:
    """DEPTH rows of cell numbers, the same in every process."""
    return _cells(_codes(pa.array(terms, pa.string()) if isinstance(terms, list) else terms.cast(pa.string()))[0], cells)


def _counted(batches):
    """(terms, cell hashes, df, ctf) of words and pairs of adjacent words, for parts of a task's texts."""
    held, n = [], 0
    for batch in batches:
        for part in blocks.pieces(batch, 0, HELD_WORDS):
            found = part.column(0)
            size = pc.sum(pc.list_value_length(found)).as_py() or 0
            if n + size > HELD_WORDS and held:
                yield _counts(held)
                held, n = [], 0
            held.append(found)
            n += size
    if held:
        yield _counts(held)


def _counts(held: list):
    found = pa.concat_arrays(held)
    size = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False)
    coded = found.flatten().cast(pa.string()).dictionary_encode()
    own, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    row = np.repeat(np.arange(len(size)), size)
    near = np.flatnonzero(row[:-1] == row[1:])
    key = np.concatenate([own, len(words) * (1 + own[near]) + own[near + 1]])
    row = np.concatenate([row, row[near]])
    by = np.argsort(key, kind="stable")  # rows of a term stay in order
    key, row = key[by], row[by]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    start = np.flatnonzero(new)
    new[1:] |= row[1:] != row[:-1]
    df = np.add.reduceat(new.astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
    ctf, key = np.diff(np.append(start, len(new))), key[start]
    bits = _codes(words)
    one = np.searchsorted(key, len(words))
    a, b = key[one:] // max(1, len(words)) - 1, key[one:] % max(1, len(words))
    terms = pa.concat_arrays([words.take(pa.array(key[:one])), pc.binary_join_element_wise(words.take(pa.array(a)), words.take(pa.array(b)), " ")])
    return terms, np.concatenate([bits[0][key[:one]], _joined((bits[0][a], bits[1][a]), (bits[0][b], bits[1][b]))]), df, ctf


_NAMES = ["block", "cells", "top", "term", "df", "ctf"]
_TOP = pa.list_(pa.struct([("term", pa.string()), ("df", pa.int64()), ("ctf", pa.int64())]))
_KINDS = [pa.int32(), pa.binary(), _TOP, pa.string(), pa.int64(), pa.int64()]


def _rows(**columns) -> pa.RecordBatch:
    """Rows of the written table, null but for these columns."""
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in zip(_NAMES, _KINDS)], _NAMES)


def _written(words: DataFrame, n: int) -> DataFrame:
    """Blocks of the tasks' sketches (block, cells), their frequent terms (top), and all their counts
    (term, df, ctf), each in columns of its own, so that each is read alone."""
    cells = width(n)

    def run(batches):
        sketch, top = np.zeros((DEPTH, cells), np.int64), {}
        for terms, bits, df, ctf in _counted(batches):
            yield _rows(term=terms, df=df, ctf=ctf)
            for row, at in zip(sketch, _cells(bits, cells)):
                row += np.bincount(at, ctf, cells).astype(np.int64)
            most = np.argsort(-ctf, kind="stable")[:n]
            for t, x, y in zip(terms.take(pa.array(most)).to_pylist(), df[most].tolist(), ctf[most].tolist()):
                a, b = top.get(t, (0, 0))
                top[t] = a + x, b + y
            if len(top) > 2 * n:
                top = dict(sorted(top.items(), key=lambda e: -e[1][1])[:n])
        used = [(i, b) for i, b in enumerate(sketch.reshape(-1, BLOCK_CELLS)) if b.any()]
        yield _rows(block=[i for i, _ in used], cells=[b.tobytes() for _, b in used])
        yield _rows(top=[[{"term": t, "df": a, "ctf": b} for t, (a, b) in top.items()]])

    path = scratch.folder(words.sparkSession, "term-counts")
    kinds = "block int, cells binary, top array<struct<term string, df bigint, ctf bigint>>, term string, df bigint, ctf bigint"
    words.mapInArrow(run, kinds).write.option("compression", "zstd").parquet(path)
    return words.sparkSession.read.parquet(path)


def _summed(blocks: DataFrame, *by) -> DataFrame:
    """Blocks of one number added up, a block at a time in each task."""

    def run(batches):
        now, total = None, None
        for batch in batches:
            for block, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(cells.as_buffer(), np.int64)
                if block == now:
                    total += x
                    continue
                if now is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "cells"])
                now, total = block, x.copy()
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "cells"])

    return blocks.repartition(*by).sortWithinPartitions("block").select("block", "cells").mapInArrow(run, "block int, cells binary")


def _most(counts: DataFrame, n: int, min_df: int) -> DataFrame:
    at = counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("ctf").alias("ctf"))
    return at.where(F.col("df") >= min_df).orderBy(F.desc("ctf"), "term").limit(n)


def most_frequent(words: DataFrame, n: int, min_df: int = 1, counts: tuple | None = None) -> DataFrame:
    """(term, df, ctf): the n terms of highest ctf among those of min_df rows or more. ``words`` has one
    column, a list of words for each row.

    counts: accumulators of the tasks' counts, and of those that shuffle.
    """
    written = _written(words, n)
    blocks = written.where("block is not null").select("block", "cells", (F.spark_partition_id() % GROUPS).alias("group"))
    # bounded by the sketch's size, whatever the corpus
    sketch = np.zeros((DEPTH * width(n) // BLOCK_CELLS, BLOCK_CELLS), np.int64)
    for r in _summed(_summed(blocks, "block", "group"), "block").toLocalIterator():
        sketch[r["block"]] = np.frombuffer(r["cells"], np.int64)
    sure = _most(written.where("top is not null").select(F.inline("top")), n, min_df).agg(F.count(F.lit(1)).alias("n"), F.min("ctf").alias("floor")).first()
    floor = sure["floor"] if sure["n"] == n else 0
    shared = words.sparkSession.sparkContext.broadcast(sketch.reshape(DEPTH, -1))

    def near(batches):
        most = shared.value
        for batch in batches:
            at = places(batch.column(0), most.shape[1])
            may = np.min([row[i] for row, i in zip(most, at)], axis=0) >= floor
            if counts:
                counts[0].add(len(may))
                counts[1].add(int(may.sum()))
            yield batch.filter(pa.array(may))

    return _most(written.where("term is not null").select("term", "df", "ctf").mapInArrow(near, "term string, df bigint, ctf bigint"), n, min_df)
