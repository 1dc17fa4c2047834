"""Periodic runs of words, found by divide and conquer (Main and Lorentz), and their collapse.

A text's words are interned as numbers. A run is a stretch of words with smallest period q
(words q apart are equal) and a length of at least max(SHORTEST, REPEATS * q) that no
neighbouring word extends. Each step of the division takes a block, finds the runs that cross
its midpoint from Z-functions of the two halves and their mirror images, and goes on with the
halves. A run that a block's border cuts was found further up, so stretches that the next word
extends are left out; of equal intervals the smallest period stays.

Before each step a block is narrowed without loss. Behind its first q words each word of a run
occurred at most q words before, and q is at most a quarter of the block: words whose last
occurrence is further away, or outside the block, bound the stretches in which runs can lie.
Ordinary text has none, so it costs one pass; a text that repeats throughout costs n log n.

Defined results: null and blank texts have no words and no runs, and collapse to the empty
text. Each row counts by itself, rows that repeat too, whatever their id. Words are the runs of
anything but six ASCII white-space bytes; the collapsed text joins them by one space. Texts
are worked on whole, one at a time. Only the two named columns are read, so no other column's
name can clash. An empty table gives no rows. Nothing shuffles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: A run has so many periods at least, and so many words.
REPEATS, SHORTEST = 4, 6
#: Words of a run behind its first period, at least: 5 for q = 1, else 3 q.
LEAST_AGAIN = 5

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def intern(words: list) -> np.ndarray:
    """Numbers of the words, equal for equal words."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int32, len(words))


def distances(ids: np.ndarray) -> np.ndarray:
    """How many words before each word it occurred last; the text's length where it didn't."""
    n = len(ids)
    small = ids.astype(np.uint16) if n and ids.max() < 1 << 16 else ids  # sorted by radix
    order = np.argsort(small, kind="stable")
    gap = np.full(n, n, np.int64)
    again = ids[order[1:]] == ids[order[:-1]]
    gap[order[1:][again]] = np.diff(order)[again]
    return gap


def common_prefix(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common prefix; pieces of growing size are compared."""
    at, step, n = 0, 16, min(len(a), len(b))
    while at < n:
        differ = a[at : min(at + step, n)] != b[at : min(at + step, n)]
        first = int(differ.argmax())
        if differ[first]:
            return at + first
        at, step = min(at + step, n), 2 * step
    return n


def z_function(s: np.ndarray, upto: int) -> np.ndarray:
    """z[i] for 1 <= i < upto: length of the longest common prefix of s and s[i:]; z[0] is 0.

    Only places that begin like s are visited; all others have 0.
    """
    n, z, left, right = len(s), [0] * upto, 0, 0
    for i in (np.flatnonzero(s[1:upto] == s[0]) + 1).tolist() if upto > 1 else ():
        k = min(z[i - left], right - i) if i < right and i > left else 0
        if i + k >= right and right < n:
            k += common_prefix(s[k:], s[i + k :])
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return np.array(z, np.int64)


def crossing(left: np.ndarray, right: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words before, words behind the midpoint, period) of the longest stretches around it with
    each period p <= most whose right part has p words or more and whose length suffices."""
    most = min(most, len(right))
    forward = np.zeros(most + 1, np.int64)
    z = z_function(right, min(most + 1, len(right)))
    forward[: len(z)] = z
    mirror = left[::-1]
    s = np.concatenate([mirror, [-1], right[:most][::-1], mirror])
    backward = z_function(s, len(mirror) + 1 + most)[len(mirror) + 1 :][::-1]  # for p = 1 to most
    p = np.arange(1, most + 1)
    forward = forward[1:]
    enough = np.flatnonzero(backward + p + forward >= np.maximum(REPEATS * p, SHORTEST))
    return backward[enough], (p + forward)[enough], p[enough]


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period."""
    n, gap, found = len(ids), distances(ids), {}
    blocks, inside = [(0, n)], np.zeros(n, np.int32)  # which run of a period up to 3 holds the word
    dense = [(0, 0)]
    while blocks:
        low, high = blocks.pop()
        size = high - low
        if size < SHORTEST:
            continue
        # two runs share fewer words than their periods' sum, so one inside another is shorter than
        # that; with four periods it can't lie inside a run of period 3 or less
        own = dense[inside[low]]
        if own[0] <= low and high <= own[1]:
            continue
        near = gap[low:high] <= np.minimum(np.arange(size), size // REPEATS)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], near, [False]]).view(np.int8)))
        for u, v in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if v - u < LEAST_AGAIN:
                continue
            u = max(0, u - (v - u) // (REPEATS - 1))
            if 4 * (v - u) <= 3 * size:  # narrow it further first
                blocks.append((low + u, low + v))
                continue
            begin, end = low + u, low + v
            middle, most = (begin + end) // 2, (end - begin) // REPEATS
            before, behind = ids[begin:middle], ids[middle:end]
            rightwards = zip(*(x.tolist() for x in crossing(before, behind, most)))
            leftwards = zip(*(x.tolist() for x in crossing(behind[::-1], before[::-1], most)))
            for a, b, p in [*rightwards, *((a, b, p) for b, a, p in leftwards)]:
                start, stop = middle - a, middle + b
                if start and ids[start - 1] == ids[start - 1 + p] or stop < n and ids[stop] == ids[stop - p]:
                    continue  # a neighbouring word extends it
                found[start, stop] = min(p, found.get((start, stop), p))
                if p <= 3:
                    inside[start:stop] = len(dense)
                    dense.append((start, stop))
            blocks += [(begin, middle), (middle, end)]
    return sorted((start, end - start, p) for (start, end), p in found.items())


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, runs, collapsed) of each row: its runs by start and period, and its words without
    those that a run holds behind its first period."""
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        for batch in batches:
            runs, texts = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = text.split() if text else []
                own = find_runs(intern(words)) if len(words) >= SHORTEST else []
                if own:
                    stays = np.ones(len(words), bool)
                    for start, length, period in own:
                        stays[start + period : start + length] = False
                    words = [words[i] for i in np.flatnonzero(stays).tolist()]
                runs.append([dict(zip(("start", "length", "period"), r)) for r in own])
                texts.append(b" ".join(words).decode("utf-8", "replace"))
            fields = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, fields), pa.array(texts, pa.string())], ["id", "runs", "collapsed"])

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"id {kind}, runs {RUNS}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equals the first. Null if none."""
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def listing(runs: Column) -> Column:
    """One line `start,length,period` for each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
