"""Nearest neighbours by inner product: a navigable small-world graph for each shard.

Vectors are dealt to shards of bounded size by their norm's band and a hash of their id.
Each shard gets one hierarchical graph, stored as flat arrays: the vectors, the level of each, and for each
level a block of neighbour numbers of fixed width. A query descends each shard's levels
and searches the lowest one with a beam; the shards' best are merged by exact scores.

Inner product becomes distance by one more coordinate, sqrt(M^2 - |x|^2), M the shard's
greatest norm; nodes are linked by that distance, in units of M, and the graph is navigated
by the inner product itself. A band spans BAND octaves of norms, so a few long
vectors neither blur the others in single precision nor overflow. Equal vectors of a shard are one node with
a list of ids, so a large group of copies doesn't crowd out other neighbours.

A shard's graph is linked from exact neighbour lists within each level (a shard is small),
thinned by the usual rule: a neighbour stays if it is nearer to the node than to the
neighbours that stay already. Links go both ways.

Defined results: vectors that are null, zero, of another length than most, or hold null
or non-finite components take no part, neither as queries nor as candidates. Ties go to
the smaller id. A query's own id is never its result; rows that repeat an id count as one
candidate each. Queries that repeat wholly are asked once; two vectors under one id are two
queries, each with its own k results. Fewer candidates than k: all of them. An empty table
gives no result. Only the two named columns are read, so no other column's name can clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows in a shard, on average: 16384 vectors of 64 floats are 4 MB, their graph 4 MB.
SHARD_ROWS = 16_384
#: Norms in a shard differ at most by so many octaves; norms are counted in steps of one by STEPS.
BAND, STEPS = 2, 16
#: Links of a node, beam of a search, nodes widened at once.
LINKS, BEAM, STEP = 32, 96, 4
#: Tasks that ask one shard, at most, and queries that are worth another task.
PARTS, PART_QUERIES = 8, 1024
#: A level has about one node in so many of the level below.
LEVEL_RATE = 16


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that can take part, as arrays of doubles."""
    at = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    return at.where("not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x != 0)")


def _nearest(x: np.ndarray, k: int, block: int = 512) -> np.ndarray:
    """Exact neighbour lists of the rows of x, by distance, without the row itself."""
    square, n = (x * x).sum(axis=1), len(x)
    k = min(k, n - 1)
    out = np.zeros((n, k), np.int32)
    for i in range(0, n, block):
        d = square[None, :] - 2 * (x[i : i + block] @ x.T)
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k] if k < n - 1 else np.tile(np.arange(n), (len(d), 1))
        by = np.argsort(np.take_along_axis(d, near, axis=1), axis=1)[:, :k]
        out[i : i + block] = np.take_along_axis(near, by, axis=1)
    return out


def _links(x: np.ndarray, width: int, block: int = 256) -> np.ndarray:
    """Neighbour numbers (rows, 2 * width), -1 where there is none, for blocks of nodes at once."""
    n = len(x)
    if n < 2:
        return np.full((n, 2 * width), -1, np.int32)
    near = _nearest(x, 3 * width)
    m = near.shape[1]
    ahead = np.full((n, width), -1, np.int32)
    for i in range(0, n, block):
        cand = near[i : i + block]
        rows = np.arange(len(cand))
        v = x[cand]
        square = (v * v).sum(axis=2)
        to_node = square + (x[i : i + block] ** 2).sum(axis=1)[:, None] - 2 * np.einsum("bkd,bd->bk", v, x[i : i + block])
        between = square[:, :, None] + square[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
        stays = np.zeros((len(cand), m), bool)
        for j in range(m):  # nearest first: j stays if no neighbour that stays is nearer to it than the node
            stays[:, j] = ~((between[:, j, :] < to_node[:, j, None]) & stays).any(axis=1) & (stays.sum(axis=1) < width)
        # those that stay, then the nearest others
        by = np.argsort(~stays, axis=1, kind="stable")[:, :width]
        ahead[i : i + len(cand), : by.shape[1]] = cand[rows[:, None], by]
    # and back: each node takes the nearest of those that link to it, where it has room
    source, target = np.repeat(np.arange(n), width), ahead.ravel()
    source, target = source[target >= 0], target[target >= 0]
    d = ((x[source] - x[target]) ** 2).sum(axis=1)
    known = np.sort(source.astype(np.int64) * n + target)
    back = target.astype(np.int64) * n + source
    new = known[np.minimum(np.searchsorted(known, back), len(known) - 1)] != back
    source, target, d = source[new], target[new], d[new]
    by = np.lexsort((d, target))
    source, target = source[by], target[by]
    place = np.arange(len(target)) - np.searchsorted(target, target)
    out = np.concatenate([ahead, np.full((n, width), -1, np.int32)], axis=1)
    fits = place < width
    out[target[fits], width + place[fits]] = source[fits]
    return out


def bands(steps: list[int]) -> dict[int, int]:
    """The band of each step of norms: the greatest norm opens the first, the greatest below it the next."""
    out, band, low = {}, -1, None
    for step in sorted(steps, reverse=True):
        if low is None or step <= low:
            band, low = band + 1, step - BAND * STEPS
        out[step] = band
    return out


def build(ids: np.ndarray, vectors: np.ndarray, width: int = LINKS, seed: int = 1) -> dict:
    """The graph of one shard as flat arrays."""
    order = np.lexsort((ids,))
    ids, vectors = ids[order], vectors[order]
    nodes, of = np.unique(vectors, axis=0, return_inverse=True)
    members = np.argsort(of.ravel(), kind="stable")
    starts = np.searchsorted(of.ravel()[members], np.arange(len(nodes) + 1))
    x = nodes / np.abs(nodes).max()
    square = (x * x).sum(axis=1)
    lift = np.sqrt(square.max() - square)
    x = (np.concatenate([x, lift[:, None]], axis=1) / np.sqrt(square.max())).astype(np.float32)
    rng = np.random.default_rng(seed)
    level = np.floor(-np.log(1 - rng.random(len(x))) / np.log(LEVEL_RATE)).astype(int)
    levels = []
    for l in range(int(level.max()) + 1):
        at = np.flatnonzero(level >= l).astype(np.int32)
        if l and len(at) < 2:
            break
        links = _links(x[at], width)
        levels.append((at, np.where(links >= 0, at[links], -1).astype(np.int32)))
    return {"ids": ids[members], "starts": starts, "nodes": nodes, "x": x, "levels": levels}


def search(graph: dict, queries: np.ndarray, beam: int = BEAM, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(node numbers, distances) of a beam for each query, nearest first; -1: none. A
    distance is the negative inner product, in units of the shard and the query."""
    x, n = graph["x"], len(queries)
    q = np.concatenate([queries / np.abs(queries).max(axis=1, keepdims=True), np.zeros((n, 1))], axis=1).astype(np.float32)
    beam = min(beam, len(x))
    top, _ = graph["levels"][-1]
    # all nodes of the highest level are looked at, then each level starts from the best so far
    d = -(q @ x[top].T)
    best = np.argsort(d, axis=1)[:, :beam]
    found, dist = top[best], np.take_along_axis(d, best, axis=1)
    for at, links in reversed(graph["levels"]):
        place = np.full(len(x), -1, np.int64)
        place[at] = np.arange(len(at))
        found, dist = _beam(x, place, links, q, found, dist, beam, step)
    return found, dist


def _beam(x, place, links, q, found, dist, beam, step):
    n = len(q)
    rows = np.arange(n)[:, None]
    pad = max(0, beam - found.shape[1])
    found = np.pad(found.astype(np.int64), ((0, 0), (0, pad)), constant_values=-1)
    dist = np.pad(dist, ((0, 0), (0, pad)), constant_values=np.inf)
    done = found < 0  # already widened, or nothing there
    seen = np.zeros((n, len(x) + 1), bool)
    seen[rows, found] = True
    seen[:, -1] = True  # the place of "none"
    while True:
        # found is sorted, so the nearest that aren't widened come first
        pick = np.argsort(done, axis=1, kind="stable")[:, :step]
        live = ~np.take_along_axis(done, pick, axis=1)
        if not live.any():
            return found, dist
        take = np.where(live, np.take_along_axis(found, pick, axis=1), -1)
        done[rows, pick] = True
        new = np.where(take[:, :, None] >= 0, links[place[take]], -1).reshape(n, -1).astype(np.int64)
        new[seen[rows, new]] = -1
        seen[rows, new] = True
        d = np.where(new >= 0, -np.matmul(x[new], q[:, :, None])[:, :, 0], np.inf)
        # only what beats the beam's last can come in
        keep = d < dist[:, -1:]
        most = int(keep.sum(axis=1).max())
        if not most:
            continue
        first = np.argsort(~keep, axis=1, kind="stable")[:, :most]
        new, d = np.take_along_axis(new, first, axis=1), np.where(np.take_along_axis(keep, first, axis=1), np.take_along_axis(d, first, axis=1), np.inf)
        found, dist, done = np.concatenate([found, new], axis=1), np.concatenate([dist, d], axis=1), np.concatenate([done, d == np.inf], axis=1)
        by = np.argsort(dist, axis=1, kind="stable")
        found, dist, done = (np.take_along_axis(v, by, axis=1) for v in (found, dist, done))
        # a node met twice in one step stands next to itself
        twice = (found[:, 1:] == found[:, :-1]) & (found[:, 1:] >= 0)
        if twice.any():
            dist[:, 1:][twice] = np.inf
            done[:, 1:][twice] = True
            by = np.argsort(dist, axis=1, kind="stable")
            found, dist, done = (np.take_along_axis(v, by, axis=1) for v in (found, dist, done))
        found, dist, done = found[:, :beam], dist[:, :beam], done[:, :beam]
        found[dist == np.inf] = -1


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, each summed in the same order, so equal vectors tie."""
    return (a * b).sum(axis=-1)


def best_of_shard(graph: dict, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """(query number, id, score) of each query's k best of one shard, ties to smaller ids."""
    found, _ = search(graph, queries, max(BEAM, 2 * k))
    for i in range(len(queries)):
        nodes = found[i, : 2 * k]  # by distance in single precision; exact scores order them
        nodes = nodes[nodes >= 0]
        scores = exact_scores(graph["nodes"][nodes], queries[i])
        ids, values = [], []
        for node, s in sorted(zip(nodes.tolist(), scores.tolist()), key=lambda p: -p[1]):
            own = graph["ids"][graph["starts"][node] : graph["starts"][node + 1]]
            own = own[own != query_ids[i]][:k]
            if len(ids) >= k and s < values[k - 1]:
                break
            ids += own.tolist()
            values += [s] * len(own)
            order = np.lexsort((ids, -np.array(values)))[:k]
            ids, values = [ids[j] for j in order], [values[j] for j in order]
        yield i, ids, values


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found among ``vectors``."""
    base = usable(vectors, id_col, vector_col)
    widths = base.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    same_width = F.size("v") == (widths[0][0] if widths else 0)
    base = base.where(same_width)
    # no square is formed, so none overflows
    norm = F.aggregate("v", F.lit(0.0), lambda acc, x: F.hypot(acc, x))
    base = base.withColumn("step", F.floor(F.log2(norm) * STEPS))
    # one row for each step of norms; doubles have some 35000 in all
    steps = {r[0]: r[1] for r in base.groupBy("step").count().collect()}
    band, sizes = bands(list(steps)), {}
    for step, n in steps.items():
        sizes[band[step]] = sizes.get(band[step], 0) + n
    # each band has shards of its own
    first, shards = {}, 0
    for b in sorted(sizes):
        first[b], shards = shards, shards - (-sizes[b] // shard_rows)
    of = base.sparkSession.createDataFrame([(step, first[b], -(-sizes[b] // shard_rows)) for step, b in band.items()], "step bigint, first int, of int")
    shards = max(1, shards)
    dealt = base.join(F.broadcast(of), "step").withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("id", "v"), F.col("of"))).cast("int"))

    def make(batches):
        rows: dict[int, list] = {}
        for batch in batches:
            for shard, i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)):
                rows.setdefault(shard, []).append((i, v))
        for shard, found in rows.items():
            g = build(np.array([r[0] for r in found], np.int64), np.array([np.asarray(r[1], np.float64) for r in found]))
            flat = [g["ids"].astype("<i8"), g["starts"].astype("<i8"), g["nodes"].astype("<f8"), g["x"].astype("<f4")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in flat),
                 pa.array([[at.astype("<i4").tobytes() for at, _ in g["levels"]]], pa.list_(pa.binary())), pa.array([[l.astype("<i4").tobytes() for _, l in g["levels"]]], pa.list_(pa.binary()))],
                ["shard", "ids", "starts", "nodes", "x", "members", "links"],
            )

    # each shard's rows meet in one task; a shard has a bounded number of rows
    index = cut(dealt.select("shard", "id", "v").repartition(2 * shards, "shard").mapInArrow(make, "shard int, ids binary, starts binary, nodes binary, x binary, members array<binary>, links array<binary>"), "graphs")
    asked = usable(queries, id_col, vector_col).where(same_width).dropDuplicates(["id", "v"])
    # a shard's queries are asked in up to PARTS tasks, each with a copy of the graph
    parts = max(1, min(PARTS, -(-asked.count() // PART_QUERIES)))
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), F.col("id").alias("query"), F.xxhash64("v").alias("which"), "v")
    graphs = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("query"), F.lit(None).cast("bigint").alias("which"), F.lit(None).cast("array<double>").alias("v"), "ids", "starts", "nodes", "x", "members", "links")
    stream = graphs.unionByName(asked, allowMissingColumns=True).repartition(shards * parts, "shard", "part").sortWithinPartitions("shard", "part", "kind")

    def ask(batches):
        graph = None
        for batch in batches:
            rows = batch.to_pylist()
            at = 0
            while at < len(rows):
                if rows[at]["kind"] == 0:
                    r = rows[at]
                    ids, starts = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["starts"], "<i8")
                    count = len(starts) - 1
                    members = [np.frombuffer(m, "<i4") for m in r["members"]]
                    graph = r["shard"], {"ids": ids, "starts": starts, "nodes": np.frombuffer(r["nodes"], "<f8").reshape(count, -1), "x": np.frombuffer(r["x"], "<f4").reshape(count, -1),
                                         "levels": [(m, np.frombuffer(l, "<i4").reshape(len(m), -1)) for m, l in zip(members, r["links"])]}
                    at += 1
                    continue
                end = at
                while end < len(rows) and rows[end]["kind"] == 1 and rows[end]["shard"] == rows[at]["shard"] and end - at < 256:
                    end += 1
                if graph is None or graph[0] != rows[at]["shard"]:
                    at = end
                    continue
                own = rows[at:end]
                out = [[], [], [], []]
                for i, ids, scores in best_of_shard(graph[1], np.array([r["query"] for r in own]), np.array([r["v"] for r in own], np.float64), k):
                    out[0] += [own[i]["query"]] * len(ids)
                    out[1] += ids
                    out[2] += scores
                    out[3] += [own[i]["which"]] * len(ids)
                yield pa.RecordBatch.from_arrays([*(pa.array(out[j], pa.int64()) for j in (0, 1)), pa.array(out[2], pa.float64()), pa.array(out[3], pa.int64())], ["query_id", "vec_id", "score", "which"])
                at = end

    found = stream.mapInArrow(ask, "query_id bigint, vec_id bigint, score double, which bigint")
    rank = F.row_number().over(Window.partitionBy("query_id", "which").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
