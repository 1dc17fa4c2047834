"""Ranked lexical search: postings traversed in windows of document ids, scores added in buckets.

Documents are indexed where they are: a task gathers up to WINDOW documents, orders them by id, and
cuts them at fixed windows of WINDOW ids. What one task holds of a window is a block of postings,
written as one row of a table: for each query term the numbers of the window's documents that hold
it and how often, beside the documents' ids and lengths. Totals and document frequencies are sums
over the blocks.

Then each block is scored for all items. An item's terms add their weights to an array of WINDOW
64-bit cells, small enough for a processor's cache, and mark the cells in a bitset; set bits are
harvested into the item's heap of k, past scores below its root. A task keeps its heaps over all
blocks it reads and hands on k rows an item, which a window function merges. Neither texts nor
postings shuffle.

Items are taken in groups of GROUP_TERMS terms in all (one group, unless there are very many
items); a group's terms are broadcast, and each group reads the documents once.

Defined results: null texts and texts without a term are no documents (they count neither in N nor
in L) and never rank. Items without a term, or whose terms no document has, have no rows. Rows that
share an item_id are one item with the terms of all. Rows that repeat a doc_id are documents of
their own, each ranked; rows without one rank behind equal scores. Fewer than k documents with a
score above 0: all of them. Only the named columns are read, so no other column's name can clash.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bounded_batches, cut

#: Document ids of a window, and documents of a block.
WINDOW = 1 << 16
#: A task hands on its blocks when it holds so many postings.
HELD_POSTINGS = 2_000_000
#: Terms of a group of items; a single item may have more.
GROUP_TERMS = 1_000_000

#: Everything but ASCII letters and digits and what lies beyond ASCII separates terms.
_SEPARATORS = bytes(c for c in range(128) if not chr(c).isalnum())
_FOLD = bytes.maketrans(bytes(range(65, 91)) + _SEPARATORS, bytes(range(97, 123)) + b" " * len(_SEPARATORS))


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return text.translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2.0 * n_docs + 2) / (2.0 * df + 1)))


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term) of each item's distinct terms, as bytes."""

    def run(batches):
        for batch in batches:
            found = [list(set(terms(t))) if t else [] for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], ["item", "terms"])

    kind = dict(items.dtypes)[id_col]
    at = items.select(F.col(f"`{id_col}`").alias("item"), F.col(f"`{text_col}`").alias("text"))
    return at.mapInArrow(run, f"item {kind}, terms array<binary>").select("item", F.explode("terms").alias("term")).distinct()


def groups(found: DataFrame, most: int = GROUP_TERMS) -> tuple[DataFrame, int]:
    """(item, term, group) and the number of groups: items dealt by hash so that no group of two or
    more items has over ``most`` terms."""
    sizes = found.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    n = max(1, -(-found.count() // most))
    while True:
        of = F.pmod(F.xxhash64("item"), F.lit(n)).cast("int")
        worst = sizes.groupBy(of).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("items")).where(F.col("items") > 1).agg(F.max("n")).collect()[0][0]
        if (worst or 0) <= most:
            return found.withColumn("group", of), n
        n *= 2


BLOCK_COLUMNS = "window bigint, docs bigint, total bigint, ids binary, known binary, sizes binary, terms array<int>, dfs array<int>, places binary, tfs binary"


def index(docs: DataFrame, vocabulary, id_col: str, text_col: str) -> DataFrame:
    """Blocks of postings of the terms in ``vocabulary``, a broadcast dict of numbers. docs, total:
    how many documents with a term a block stands for, and all their terms with repeats."""
    names = [c.split()[0] for c in BLOCK_COLUMNS.split(", ")]

    def blocks(held, term, tf):
        term, tf = np.array(term, np.int32), np.array(tf, np.int64)
        first = np.cumsum([0, *(d[2] for d in held)])
        order = sorted(range(len(held)), key=lambda i: (held[i][0] is None, held[i][0] or 0))
        windows = [None if held[i][0] is None else held[i][0] // WINDOW for i in order]
        start = 0
        while start < len(order):
            end = start
            while end < len(order) and windows[end] == windows[start]:
                end += 1
            own = order[start:end]
            at = np.concatenate([np.arange(first[i], first[i + 1]) for i in own])
            yield _block(windows[start], [held[i] for i in own], term[at], tf[at], names)
            start = end

    def run(batches):
        number, held, term, tf = vocabulary.value, [], array("i"), array("q")
        documents, total = 0, 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                found = terms(text) if text else ()
                if not found:
                    continue
                documents, total, before = documents + 1, total + len(found), len(term)
                for t, n in Counter(found).items():
                    at = number.get(t)
                    if at is not None:
                        term.append(at)
                        tf.append(n)
                if len(term) > before:
                    held.append((i, len(found), len(term) - before))
                if len(held) == WINDOW or len(term) >= HELD_POSTINGS:
                    yield from blocks(held, term, tf)
                    held, term, tf = [], array("i"), array("q")
        yield from blocks(held, term, tf)
        # what the task's documents count for, with the last row
        yield _block(None, [], np.zeros(0, np.int32), np.zeros(0, np.int64), names, documents, total)

    at = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return at.mapInArrow(run, BLOCK_COLUMNS)


def _block(window, held, term, tf, names, documents=0, total=0) -> pa.RecordBatch:
    """held: (id, terms with repeats, postings) of each document, whose postings follow each other."""
    place = np.repeat(np.arange(len(held)), [d[2] for d in held])
    by = np.argsort(term, kind="stable")
    own, dfs = np.unique(term, return_counts=True)
    values = [
        window, documents, total, np.array([d[0] or 0 for d in held], "<i8").tobytes(), np.array([d[0] is not None for d in held], bool).tobytes(),
        np.array([d[1] for d in held], "<i8").tobytes(), own.tolist(), dfs.tolist(), place[by].astype("<i4").tobytes(), tf[by].astype("<i8").tobytes(),
    ]
    kinds = [pa.int64()] * 3 + [pa.binary()] * 3 + [pa.list_(pa.int32())] * 2 + [pa.binary()] * 2
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)


class Buckets:
    """The cells of a window: 64-bit sums, and a bitset of those that hold one."""

    def __init__(self):
        self.sums, self.bits = np.zeros(WINDOW, np.int64), np.zeros(WINDOW // 64, np.uint64)

    def add(self, places: np.ndarray, values: np.ndarray) -> None:
        """``places`` are distinct and ascending, as a term's postings are."""
        self.sums[places] += values
        words, first = np.unique(places >> 6, return_index=True)
        self.bits[words] |= np.bitwise_or.reduceat(np.uint64(1) << (places & 63).astype(np.uint64), first)

    def harvest(self) -> tuple[np.ndarray, np.ndarray]:
        """Set cells and their sums; leaves all cells empty."""
        words = np.flatnonzero(self.bits)
        set_ = np.unpackbits(self.bits[words].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
        places = ((words << 6)[:, None] + np.arange(64)[None, :])[set_]
        sums = self.sums[places]
        self.sums[places] = 0
        self.bits[words] = 0
        return places, sums


def gains(tf: np.ndarray, size: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """(10**9 tf) div (1000 tf + 20 m), m = 100 - 50 + ((50 n N) div L), for each posting."""
    largest = int(size.max()) * 50 * n_docs if len(size) else 0
    m = 50 + (50 * size * n_docs // total if largest < 1 << 63 else (50 * size.astype(object) * n_docs // total).astype(np.int64))
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def score_block(row: dict, items: list, weights: np.ndarray, n_docs: int, total: int, buckets: Buckets, heaps: list, k: int) -> None:
    """Adds the block's best documents to the items' heaps. items: (id, numbers of its terms)."""
    ids, known, size = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["known"], bool), np.frombuffer(row["sizes"], "<i8")
    places, tf = np.frombuffer(row["places"], "<i4"), np.frombuffer(row["tfs"], "<i8")
    if not len(places):
        return
    gain = gains(tf, size[places], n_docs, total)
    end = np.cumsum(row["dfs"])
    where = {t: slice(e - n, e) for t, n, e in zip(row["terms"], row["dfs"], end.tolist())}
    for (_, own), heap in zip(items, heaps):
        for t in own:
            at = where.get(t)
            if at is not None and weights[t]:
                buckets.add(places[at], weights[t] * gain[at])
        cells, sums = buckets.harvest()
        least = heap[0][0] if len(heap) == k else 1
        good = sums >= least
        cells, sums = cells[good], sums[good]
        if len(cells) > k:
            # documents are in the order of their ids, rows without one last
            first = np.lexsort((cells, -sums))[:k]
            cells, sums = cells[first], sums[first]
        for c, s in zip(cells.tolist(), sums.tolist()):
            entry = (s, bool(known[c]), -int(ids[c]))
            if len(heap) < k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", group_terms: int = GROUP_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k documents with the greatest score above 0."""
    spark = docs.sparkSession
    bounded_batches(spark)
    asked = cut(item_terms(items, item_id, item_text), "lexical-items")
    dealt, n = groups(asked, group_terms)
    found = None
    for g in range(n):
        part = _ranked_group(docs, dealt.where(F.col("group") == g), k, doc_id, text_col)
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _ranked_group(docs: DataFrame, asked: DataFrame, k: int, doc_id: str, text_col: str) -> DataFrame:
    spark, kind = docs.sparkSession, dict(asked.dtypes)["item"]
    number, own = {}, {}  # a group's terms are bounded
    for r in asked.select("item", "term").collect():
        own.setdefault(r["item"], []).append(number.setdefault(bytes(r["term"]), len(number)))
    items = sorted(own.items(), key=lambda p: (p[0] is None, p[0] if p[0] is not None else 0))
    stored = cut(index(docs, spark.sparkContext.broadcast(number), doc_id, text_col), "lexical-blocks")
    totals = stored.agg(F.sum("docs"), F.sum("total")).collect()[0]
    n_docs, total = totals[0] or 0, totals[1] or 0
    weights = np.zeros(len(number), np.int64)
    pairs = stored.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy(F.col("x.terms").alias("t")).agg(F.sum("x.dfs").alias("df"))
    for r in pairs.collect():
        weights[r["t"]] = weight(n_docs, r["df"])
    shared = spark.sparkContext.broadcast((items, weights))

    def run(batches):
        items, weights = shared.value
        buckets, heaps = Buckets(), [[] for _ in items]
        for batch in batches:
            for i in range(len(batch)):
                score_block(batch.slice(i, 1).to_pylist()[0], items, weights, n_docs, total, buckets, heaps, k)
        for (item, _), heap in zip(items, heaps):
            if heap:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(heap), to_arrow_type(kind_)), pa.array([-d if there else None for _, there, d in heap], pa.int64()), pa.array([s for s, _, _ in heap], pa.int64())],
                    ["item_id", "doc_id", "score"],
                )

    kind_ = asked.schema["item"].dataType
    return stored.where("docs = 0").drop("window", "docs", "total").mapInArrow(run, f"item_id {kind}, doc_id bigint, score bigint")
