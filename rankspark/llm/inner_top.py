"""Exact k greatest inner products of integer vectors, by descending length and rotated partial sums.

All vectors are turned by one rotation, the right singular vectors of a bounded sample, so that
the first coordinates hold most of their length; a rotation changes no inner product. Candidates
are range-partitioned by descending length and packed into blocks; a block has the integer
vectors, the rotated ones, and the lengths of what each has left behind two numbers of leading
coordinates (SHARES of the sample's energy).

The block with the longest vectors gives each query a first threshold, its k-th score so far.
Then each block of queries meets only blocks that are long enough for one of its thresholds.
Within a block candidates come by descending length in runs of RUN: a query whose threshold is
above length times length stops there; of the others the partial sum over the first coordinates
plus the product of what is left (Cauchy and Schwarz) bounds each score, then the same with more
coordinates, and only what is still above the threshold gets an exact integer score. Bounds are
widened by more than the rounding of doubles, so results are exact and don't depend on the
sample, on blocks or on partitions.

Work and shuffles: as every query is asked of all rows, pairs of blocks grow with queries times
rows; skipped blocks aren't shipped. One group of query blocks of up to BROADCAST_BYTES is broadcast;
more meet the candidates' blocks in a join of blocks.

Defined results: vectors that are null, empty, of another length than most, or hold a null take
no part, nor do rows without an id. Zero vectors do, with scores of 0. Ties go to the smaller id.
A query's own id is never its result; rows that repeat an id count as one candidate each.
Queries that repeat wholly are asked once; two vectors under one id are two queries, each with
its own k results. Fewer candidates than k: all of them. A score beyond 64 bits counts as the
nearest number of 64 bits. An empty table gives no result. Only the two named columns are read,
so no other column's name can clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import bounded_batches, cut

#: Rows of a block of candidates and of queries.
BLOCK, QUERY_BLOCK = 4096, 1024
#: Numbers in the sample that the rotation is learned from: 2**22 are 32 MB.
SAMPLE_NUMBERS = 1 << 22
#: Shares of the sample's energy that the two partial sums have.
SHARES = (0.7, 0.9)
#: Candidates bounded at once, and pairs scored at once.
RUN, PAIRS = 512, 1 << 15
BROADCAST_BYTES = 32 << 20
#: Doubles hold integers up to here exactly.
EXACT = float(1 << 53)

BLOCK_FIELDS = [("first", pa.int64()), ("top", pa.float64()), *((c, pa.binary()) for c in ("ids", "x", "turned", "length", "rest"))]
QUERY_FIELDS = [*BLOCK_FIELDS, ("floor", pa.binary()), ("need", pa.float64())]


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as a double; null where a component is null or not finite."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))))


def _usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    at = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<bigint>").alias("v"))
    return at.where("id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null)")


def _matrix(column, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def rotation(rows: DataFrame, n: int, width: int) -> tuple[np.ndarray, list[int]]:
    """Right singular vectors of about SAMPLE_NUMBERS / width rows, drawn by a hash of the vector
    and the id, and the numbers of leading coordinates with SHARES of their energy. Only width
    times width numbers reach the driver."""
    share = min(1.0, max(256, SAMPLE_NUMBERS // width) / max(1, n))
    drawn = rows.where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def learn(batches):
        total = np.zeros((width, width))
        for batch in batches:
            x = _matrix(pa.Table.from_batches([batch]).column("v"), width).astype(float)
            length = np.linalg.norm(x, axis=1, keepdims=True)
            x = x / np.where(length > 0, length, 1)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    got = drawn.select("v").repartition(1).mapInArrow(learn, "total binary").collect()  # one bounded sample
    total = np.frombuffer(got[0]["total"]).reshape(width, width) if got else np.zeros((width, width))
    energy, turn = np.linalg.eigh(total)
    energy, turn = np.maximum(energy[::-1], 0), np.ascontiguousarray(turn[:, ::-1])
    grown = np.cumsum(energy) / max(energy.sum(), 1e-300)
    firsts = [min(width, int(np.searchsorted(grown, s) + 1)) for s in SHARES]
    return turn, firsts


def _packed(rows: DataFrame, turn: np.ndarray, firsts: list[int], at_most: int) -> DataFrame:
    """Blocks of rows (id, v) in their order, up to ``at_most`` each."""
    width = len(turn)

    def out(held):
        t = pa.Table.from_batches(held)
        ids, x = t.column("id").to_numpy(), _matrix(t.column("v"), width)
        turned = x.astype(float) @ turn
        length = np.linalg.norm(x.astype(float), axis=1)
        by = np.lexsort((ids, -length))
        rest = np.stack([np.linalg.norm(turned[:, f:], axis=1) for f in firsts], axis=1)
        flat = [ids[by].astype("<i8"), x[by].astype("<i8"), turned[by], length[by], rest[by]]
        return pa.RecordBatch.from_arrays([pa.array([ids[by[0]]], pa.int64()), pa.array([length.max()], pa.float64()), *(pa.array([a.tobytes()], pa.binary()) for a in flat)], schema=pa.schema(BLOCK_FIELDS))

    def pack(batches):
        held, n = [], 0
        for batch in batches:
            while len(batch):
                part = batch.slice(0, at_most - n)
                batch = batch.slice(len(part))
                held.append(part)
                n += len(part)
                if n == at_most:
                    yield out(held)
                    held, n = [], 0
        if held:
            yield out(held)

    return rows.mapInArrow(pack, from_arrow_schema(pa.schema(BLOCK_FIELDS)))


def _arrays(block: dict, width: int) -> dict:
    ids = np.frombuffer(block["ids"], "<i8")
    return {
        "ids": ids, "x": np.frombuffer(block["x"], "<i8").reshape(-1, width), "turned": np.frombuffer(block["turned"]).reshape(-1, width),
        "length": np.frombuffer(block["length"]), "rest": np.frombuffer(block["rest"]).reshape(len(ids), -1),
    }


def exact_scores(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Integer inner products of rows. ``most`` bounds their size: up to 2**53 products of doubles
    are exact in any order of summing."""
    if most < EXACT:
        return np.einsum("ij,ij->i", a.astype(float), b.astype(float)).astype(np.int64)
    exact = (a.astype(object) * b.astype(object)).sum(axis=1)
    return np.array([min(max(s, -(1 << 63)), (1 << 63) - 1) for s in exact], np.int64)


class Best:
    """The k best (score, id) so far of each query of a block."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.ids, self.scores, self.have = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64), np.zeros(n, np.int64)
        self.floor = np.full(n, -np.inf) if floor is None else floor.copy()
        self.k = k

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        own = np.unique(query)
        old = np.repeat(own, self.have[own])
        place = np.concatenate([np.arange(h) for h in self.have[own]]).astype(int) if len(own) else old
        query = np.concatenate([old, query])
        ids = np.concatenate([self.ids[old, place], ids])
        scores = np.concatenate([self.scores[old, place], scores])
        by = np.lexsort((ids, ~scores, query))  # ~ turns the order without overflow
        query, ids, scores = query[by], ids[by], scores[by]
        first = np.searchsorted(query, own)
        rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        keep = rank < self.k
        query, ids, scores, rank = query[keep], ids[keep], scores[keep], rank[keep]
        self.ids[query, rank], self.scores[query, rank] = ids, scores
        self.have[own] = np.minimum(np.bincount(query, minlength=len(self.have))[own], self.k)
        full = own[self.have[own] == self.k]
        self.floor[full] = np.maximum(self.floor[full], self.scores[full, self.k - 1].astype(float))


def search(q: dict, c: dict, best: Best, firsts: list[int]) -> int:
    """Adds to ``best`` what the candidates c have for the queries q; the number of exact scores."""
    scored = 0
    for start in range(0, len(c["ids"]), RUN):
        run = slice(start, start + RUN)
        length, rest, turned = c["length"][run], c["rest"][run], c["turned"][run]
        reach = q["length"] * length[0]
        slack = 0.5 + 1e-11 * reach  # scores are whole numbers; doubles err by less
        alive = np.flatnonzero(reach >= best.floor - slack)
        if not len(alive):
            break  # those behind are shorter still
        f, g = firsts
        part = q["turned"][alive, :f] @ turned[:, :f].T
        qi, ci = np.nonzero(part + q["rest"][alive, :1] * rest[None, :, 0] >= (best.floor - slack)[alive, None])
        part = part[qi, ci]
        qi = alive[qi]
        for at in range(0, len(qi), PAIRS):
            a, b = qi[at : at + PAIRS], ci[at : at + PAIRS]
            if g > f:
                more = part[at : at + PAIRS] + np.einsum("ij,ij->i", q["turned"][a, f:g], turned[b, f:g])
                near = more + q["rest"][a, 1] * rest[b, 1] >= best.floor[a] - slack[a]
                a, b = a[near], b[near]
            near = q["ids"][a] != c["ids"][run][b]
            a, b = a[near], b[near]
            if not len(a):
                continue
            scored += len(a)
            scores = exact_scores(q["x"][a], c["x"][run][b], float(q["length"].max() * length[0]))
            good = scores.astype(float) >= best.floor[a]
            best.add(a[good], c["ids"][run][b][good], scores[good])
    return scored


def top_products(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "v", block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k greatest inner products among ``vectors``,
    both (id, array<bigint>)."""
    bounded_batches(vectors.sparkSession)
    rows = _usable(vectors, id_col, vector_col)
    widths = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    width, n = (widths[0][0], widths[0][1]) if widths else (1, 0)
    rows = rows.where(F.size("v") == width)
    asked = _usable(queries, id_col, vector_col).where(F.size("v") == width).dropDuplicates(["id", "v"])
    turn, firsts = rotation(rows, n, width)
    # a row takes 16 bytes a component and some more: blocks of wide vectors hold fewer
    most = max(16, BROADCAST_BYTES // (20 * width))
    block, query_block = min(block, most), min(QUERY_BLOCK, most)

    norm = F.aggregate("v", F.lit(0.0), lambda acc, x: F.hypot(acc, x.cast("double")))
    # equal lengths, and rows that repeat, are spread by id and place
    by = [F.desc("norm"), F.col("id"), F.col("place")]
    at = rows.withColumn("norm", norm).withColumn("place", F.monotonically_increasing_id()).repartitionByRange(max(1, -(-n // block)), *by)
    stored = cut(_packed(at.sortWithinPartitions(*by).select("id", "v"), turn, firsts, block), "inner-blocks")
    longest = stored.agg(F.max_by("first", F.struct("top", "first"))).collect()[0][0]
    n_asked = asked.count()
    asked = asked.repartition(max(1, -(-n_asked // query_block)))
    asked = _packed(asked, turn, firsts, query_block)

    # each query's k-th score within the block of the longest vectors
    def first(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q, c = (_arrays(row[s], width) for s in ("q", "c"))
                best = Best(len(q["ids"]), k)
                search(q, c, best, firsts)
                need = (best.floor - 0.5 - 1e-11 * np.abs(best.floor)) / np.maximum(q["length"], 1e-300)
                need = np.where(q["length"] > 0, need, np.where(best.floor <= 0, -np.inf, np.inf))
                yield pa.RecordBatch.from_pylist([{**row["q"], "floor": best.floor.tobytes(), "need": float(need.min() * (1 - 1e-9) if need.min() > 0 else need.min())}], pa.schema(QUERY_FIELDS))

    one = stored.where(F.col("first") == F.lit(longest)).select(F.struct("*").alias("c")).limit(1)
    known = cut(asked.select(F.struct("*").alias("q")).crossJoin(F.broadcast(one)).mapInArrow(first, from_arrow_schema(pa.schema(QUERY_FIELDS))), "inner-queries")

    def rest(batches):
        held: dict = {}  # of each block of queries, the k best that this task has found
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                key = hash_of(row["q"]["ids"]), hash_of(row["q"]["x"])
                if key not in held:
                    q = _arrays(row["q"], width)
                    held[key] = q, Best(len(q["ids"]), k, np.frombuffer(row["q"]["floor"]))
                search(held[key][0], _arrays(row["c"], width), held[key][1], firsts)
        for q, best in held.values():
            there = np.arange(k)[None, :] < best.have[:, None]
            which, _ = np.nonzero(there)
            digest = pa.array([hash_of(x.tobytes()) for x in q["x"]], pa.int64()).take(pa.array(which))
            yield pa.RecordBatch.from_arrays([pa.array(q["ids"][which], pa.int64()), digest, pa.array(best.ids[there], pa.int64()), pa.array(best.scores[there], pa.int64())], ["query_id", "which", "vec_id", "score"])

    small = n_asked * width * 20 <= BROADCAST_BYTES
    q = known.select(F.struct("*").alias("q"))
    met = stored.select(F.struct("*").alias("c")).join(F.broadcast(q) if small else q, F.col("c.top") >= F.col("q.need"))
    found = met.mapInArrow(rest, "query_id bigint, which bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id", "which").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def hash_of(x: bytes) -> int:
    """A number of 64 bits, to tell two vectors under one id apart."""
    return xxhash.xxh64_intdigest(x) - (1 << 63)
