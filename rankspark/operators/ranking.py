"""Rankings of candidates for many queries at once, and their fusion.

A ranking is a table (query_id, candidate_id, rank, score). Narrow ids are ranked first;
names, texts and parsed records are joined to the k rows that stay.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import EVAL_PREFIX, clamp01, excerpt, parsed_score, prompt
from . import blocks, scoring

#: Rows in a block: 2048 queries of 1024 dimensions are 16 MB.
QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 4096


def production(df: DataFrame, source: str = "source_file") -> DataFrame:
    """Without labelled evaluation rows; `_` of the LIKE pattern is a wildcard."""
    return df.where(~F.col(source).like(f"{EVAL_PREFIX}%"))


def in_scope(df: DataFrame, scope: str, source: str = "source_file") -> DataFrame:
    like = F.col(source).like(f"{EVAL_PREFIX}%")
    return df if scope == "all" else df.where(like if scope == "eval" else ~like)


def top_k(df: DataFrame, k: int, *order: Column, by: str = "query_id") -> DataFrame:
    """The first k rows of each query with their rank; Spark limits each partition first."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def semantic(queries: DataFrame, candidates: DataFrame, k: int, counts: tuple | None = None) -> DataFrame:
    """Exact nearest by cosine, of (query_id, embedding) among (candidate_id, embedding).

    Unit vectors are packed into blocks where they are and ordered into clusters; a cluster whose
    vectors are all too far from a query, by the triangle inequality of angles, isn't scored for it.
    Only the k best of each query leave a task. Null and zero vectors, and those of another length than
    a query's, never rank. Ties go to smaller ids. counts: as in blocks.pairs.
    """
    asked = queries.where("embedding is not null").select(F.col("query_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    kept = candidates.where("embedding is not null").select(F.col("candidate_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    one = asked.count() <= QUERY_BLOCK
    q = blocks.packed(asked, _unit, "ids binary, width int, unit binary", QUERY_BLOCK, gather=True)
    found = blocks.pairs(q, kept, _clustered, "ids binary, width int, unit binary, first binary, centre binary, reach binary", CANDIDATE_BLOCK, one, _cosines, k, counts)
    return top_k(found, k, F.desc(F.round("score", 9)), F.col("candidate_id")).withColumn("score", clamp01(F.col("score"))).select("query_id", "candidate_id", "rank", "score")


def _units(rows):
    """Ids and unit vectors of the rows, for each length of vectors."""
    values = rows.column("v").combine_chunks()
    length, every = np.diff(values.offsets.to_numpy()), rows.column("id").to_numpy()
    for width in np.unique(length[length > 0]).tolist():
        own = np.flatnonzero(length == width)
        x = values.take(own).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        ids, size = every[own], np.linalg.norm(x, axis=1)
        if (size > 0).any():
            yield ids[size > 0], x[size > 0] / size[size > 0, None]


def _unit(rows):
    for ids, x in _units(rows):
        yield ids.astype("<i8").tobytes(), x.shape[1], x.astype("<f8").tobytes()


def clusters(x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of the rows, first place of each cluster, its centre, its least cosine to the centre):
    unit vectors by the nearest of some of them, spread by id, whose means then take their place."""
    n = -(-len(x) // blocks.GROUP)
    centre = x[np.argsort(ids, kind="stable")[np.linspace(0, len(x) - 1, n).astype(int)]]
    for _ in range(3):
        own = np.argmax(x @ centre.T, axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1)
        centre = np.where(size[:, None] > 1e-9, total / np.maximum(size, 1e-9)[:, None], centre)
    own = np.argmax(x @ centre.T, axis=1)
    order = np.lexsort((ids, own))
    used, first = np.unique(own[order], return_index=True)
    centre = centre[used]
    reach = np.minimum.reduceat(np.einsum("ij,ij->i", x[order], centre[np.searchsorted(used, own[order])]), first)
    return order, first, centre, reach


def _clustered(rows):
    """As _unit, in the order of clusters."""
    for ids, x in _units(rows):
        order, first, centre, reach = clusters(x, ids)
        yield ids[order].astype("<i8").tobytes(), x.shape[1], x[order].astype("<f8").tobytes(), first.astype("<i8").tobytes(), centre.astype("<f8").tobytes(), reach.astype("<f8").tobytes()


def _cosines(q: dict, c: dict) -> tuple | None:
    if q["width"] != c["width"]:
        return None
    (asked, ids), first = (np.frombuffer(b["ids"], "<i8") for b in (q, c)), np.frombuffer(c["first"], "<i8")
    x, y, centre = (np.frombuffer(b, "<f8").reshape(-1, q["width"]) for b in (q["unit"], c["unit"], c["centre"]))
    # no member's angle to a query is under the centre's less the cluster's greatest
    angle, wide = (np.arccos(np.clip(a, -1, 1)) for a in (x @ centre.T, np.frombuffer(c["reach"], "<f8")))
    bound = np.cos(np.maximum(angle - wide - 1e-7, 0))
    parts = [slice(a, b) for a, b in zip(first, np.append(first[1:], len(ids)))]
    return asked, [ids[p] for p in parts], bound, lambda own, g: x[own] @ y[parts[g]].T


def fuse(rankings: list[DataFrame], k: int, rrf_k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: sum of 1 / (60 + rank). A tie goes to what an earlier ranking
    has, then to its better rank. One union and one grouped sum; no full outer join."""
    union = None
    for i, r in enumerate(rankings):
        part = r.select("query_id", "candidate_id", "rank", F.lit(i).alias("src"))
        union = part if union is None else union.unionByName(part)
    scored = union.groupBy("query_id", "candidate_id").agg(F.sum(F.lit(1.0) / (F.lit(rrf_k) + F.col("rank"))).alias("score"), F.min(F.struct("src", "rank")).alias("seen"))
    return top_k(scored, k, F.desc(F.round("score", 12)), F.col("seen"), F.col("candidate_id")).select("query_id", "candidate_id", "rank", "score")


def with_payload(ranking: DataFrame, candidates: DataFrame, *columns: str) -> DataFrame:
    """Late join: columns of the candidates that stayed."""
    return ranking.join(candidates.select("candidate_id", *columns), "candidate_id", "left")


# --- rerank ------------------------------------------------------------------------------


def overlap_score(query: Column, text: Column) -> Column:
    """Deterministic offline scorer: share of the query's distinct tokens that the text has."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)))
    q = words(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, words(text))) / F.size(q)).otherwise(0.0)


def with_prompts(pairs: DataFrame, prompts: scoring.Prompts) -> DataFrame:
    """Adds system and prompt to pairs with query_text or description, raw_text, and what there is of
    title, name and the parsed record."""
    have = lambda c: F.col(c) if c in pairs.columns else F.lit(None)
    title, text = have("title").cast("string"), F.col("description" if "description" in pairs.columns else "query_text")
    parsed = F.col("parsed") if "parsed" in pairs.columns else F.lit(None).cast(schemas.PARSED)
    if prompts.user is None:
        user = prompt(title, text, parsed, F.col("raw_text"))
    else:
        lines = lambda c, f: F.array_join(F.transform(F.slice(parsed[c], 1, 5), f), "\n")
        user = scoring.filled(prompts.user, {
            "title": title, "description": excerpt(text), "name": have("name"), "languages": F.array_join(parsed["languages_detected"], ", "), "skills": F.array_join(F.slice(parsed["skills"], 1, 30), "; "),
            "experience": lines("experience", lambda e: F.concat_ws(" ", e["role"], e["organization"], e["start"], e["end"])),
            "education": lines("education", lambda e: F.concat_ws(" ", e["degree"], e["institution"], e["end"])), "raw_text": excerpt(F.col("raw_text"), 4000),
        })
    return pairs.withColumn("system", prompts.system(F.concat_ws(" ", title, text))).withColumn("prompt", user)


def rerank(shortlist: DataFrame, queries: DataFrame, candidates: DataFrame, k: int, scorer=None, prompts: scoring.Prompts | None = None) -> DataFrame:
    """Scores each shortlisted pair, sorts by it, keeps k.

    scorer: a scoring.Scorer, which is asked about each pair once (its answers are written); or a
    function that takes a DataFrame with query_text and raw_text and adds ``answer``, a JSON string;
    without one, token overlap scores. A pair without an answer, or whose answer doesn't parse, keeps
    its retriever's score, unexplained.
    """
    at = shortlist.withColumnRenamed("rank", "retriever_rank").withColumnRenamed("score", "retriever_score")
    q = queries.select("query_id", *[c for c in ("query_text", "title", "description") if c in queries.columns])
    c = candidates.select("candidate_id", "raw_text", *[c for c in ("name", "parsed") if c in candidates.columns])
    at = at.join(q, "query_id").join(c, "candidate_id", "left").withColumn("raw_text", F.coalesce("raw_text", F.lit("")))
    if scorer is None:
        at = at.withColumn("got", F.struct(overlap_score(F.col("query_text"), F.col("raw_text")).alias("score"), F.lit("token overlap").alias("explanation")))
    elif isinstance(scorer, scoring.Scorer):
        asked = with_prompts(at, prompts or scoring.Prompts()).select("query_id", "candidate_id", "retriever_rank", "retriever_score", "system", "prompt")
        at = scoring.asked_once(asked, scorer).withColumn("got", parsed_score(F.col("answer")))
    else:
        at = scorer(at).withColumn("got", parsed_score(F.col("answer")))
    at = at.withColumn("score", F.coalesce(F.col("got.score"), clamp01(F.col("retriever_score")))).withColumn("explanation", F.col("got.explanation"))
    return top_k(at, k, F.desc(F.round("score", 9)), F.col("retriever_rank")).select("query_id", "candidate_id", "rank", "score", "explanation")


# --- evaluation --------------------------------------------------------------------------


def judged(ranking: DataFrame, qrels: DataFrame) -> DataFrame:
    """Ranking rows with ``hit``: whether (query_id, candidate_id) is in ``qrels``."""
    return ranking.join(qrels.select("query_id", "candidate_id", F.lit(True).alias("rel")).distinct(), ["query_id", "candidate_id"], "left").withColumn("hit", F.coalesce("rel", F.lit(False))).drop("rel")


def metrics(queries: DataFrame, ranking: DataFrame, qrels: DataFrame, ks: tuple = (1, 3, 5, 10), ndcg_k: int = 5, cut: int = 10) -> DataFrame:
    """P@k, MRR within ``cut`` and NDCG of each query; a query without results scores 0."""
    at = judged(ranking, qrels)
    hit = F.col("hit")
    sums = [F.sum(F.when(hit & (F.col("rank") <= k), 1.0).otherwise(0.0)).alias(f"h{k}") for k in ks]
    per = at.groupBy("query_id").agg(*sums, F.min(F.when(hit & (F.col("rank") <= cut), F.col("rank"))).alias("first"), F.sum(F.when(hit & (F.col("rank") <= ndcg_k), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"))
    relevant = qrels.select("query_id", "candidate_id").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    at = queries.select("query_id").distinct().join(per, "query_id", "left").join(relevant, "query_id", "left").withColumn("n_relevant", F.coalesce("n_relevant", F.lit(0)))
    ideal = F.aggregate(F.sequence(F.lit(1), F.lit(ndcg_k)), F.lit(0.0), lambda s, i: s + F.when(i <= F.col("n_relevant"), 1 / F.log2(i + 1.0)).otherwise(0.0))
    zero = F.lit(0.0)
    return at.select(
        "query_id", F.col("n_relevant").cast("long").alias("n_relevant"),
        *[(F.coalesce(F.col(f"h{k}"), zero) / k).alias(f"p_at_{k}") for k in ks],
        F.coalesce(1.0 / F.col("first"), zero).alias("mrr"), F.when(ideal > 0, F.coalesce("dcg", zero) / ideal).otherwise(0.0).alias(f"ndcg_{ndcg_k}"),
    )


def macro(per_query: DataFrame) -> DataFrame:
    return per_query.agg(*[F.avg(c).alias(c) for c in per_query.columns if c not in ("query_id", "n_relevant")])


def random_baseline(categories: int, ks: tuple = (1, 3, 5, 10)) -> dict[int, float]:
    """min(1, k / categories): the printed baseline, whatever the expected P@k is."""
    return {k: min(1.0, k / categories) if categories else 0.0 for k in ks}
