"""TF-IDF in the DataFrame API: fit to tables, sparse search, category boost.

Terms are lower-case words of two or more word characters without stop words, and pairs of
words that are then adjacent. Weights are (1 + ln tf) (ln((1 + n) / (1 + df)) + 1), each
document's of length one. The fitted state is two tables, vocabulary and weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clamp01
from . import blocks, frequent, scratch
from .ranking import top_k

#: Offline default; pass other lists as a parameter.
STOP_WORDS = tuple(
    "a about after all also am an and any are as at be because been before being but by can did do does for from had has have he her him his how i if in into is it its "
    "me more most my no nor not of on once only or other our out over own s same she so some such t than that the their them then there these they this those to too under "
    "until up very was we were what when where which while who whom why will with you your "
    "а без бы был была были было быть в вам вас во вот все всё всех вы где да даже для до его ее если есть еще же за и из или им их к как ко когда кто ли либо мне "
    "мы на над не нет ни но о об он она они от по под при с со так также такой там те тем то того тоже только том ты у уже чем что чтобы эта эти это я".split()
)


def words(text: Column, stop_words: tuple = STOP_WORDS) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*stop_words)) if stop_words else found


def vocabulary(corpus: DataFrame, text_col: str, min_df: int = 2, max_features: int = 20_000, stop_words: tuple = STOP_WORDS, n_docs: int | None = None, counts: tuple | None = None) -> DataFrame:
    """(term, df, ctf, idf): terms of min_df documents or more, the most frequent first. The
    result has at most max_features rows, so it may be broadcast. A row is a document.

    Each task counts the terms of its own texts; only partial counts of terms that may be among
    the most frequent shuffle (operators.frequent, which has ``counts`` too).
    """
    found = blocks.spread(corpus.select(text_col)).select(words(F.col(text_col), stop_words).alias("w"))
    at = frequent.most_frequent(found, max_features, min_df, counts)
    n = corpus.count() if n_docs is None else n_docs
    return at.withColumn("idf", F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1.0)


def vectors(docs: DataFrame, id_col: str, text_col: str, vocab: DataFrame, stop_words: tuple = STOP_WORDS, carry: tuple = ()) -> DataFrame:
    """(id, at, w) of each row: places of its terms in the vocabulary's order of terms, and
    weights, of length one. The rows stay where they are. The vocabulary goes to every task:
    it has max_features rows at most. A row without a term has empty arrays."""
    listed = sorted((r["term"], r["idf"]) for r in vocab.select("term", "idf").collect())
    idf = np.array([x for _, x in listed])
    parts = [t.split(" ") for t, _ in listed]
    known = {w: i for i, w in enumerate(dict.fromkeys(w for p in parts for w in p))}
    names, one = pa.array(list(known), pa.string()), np.full(len(known) + 1, -1)
    one[[known[p[0]] for p in parts if len(p) == 1]] = [i for i, p in enumerate(parts) if len(p) == 1]
    two = sorted((known[p[0]] * len(known) + known[p[1]], i) for i, p in enumerate(parts) if len(p) == 2)
    pair, pair_place = (np.array([x[j] for x in two] + [-1], np.int64) for j in (0, 1))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def terms(found):
        """Rows of a column of words, terms' places in order for each row, and how often it has them."""
        size = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False)
        own = pc.fill_null(pc.index_in(found.flatten().cast(pa.string()), value_set=names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(size)), size)
        near = np.flatnonzero((row[:-1] == row[1:]) & (own[:-1] >= 0) & (own[1:] >= 0))
        key = own[near] * len(names) + own[near + 1]
        at = np.searchsorted(pair[:-1], key)
        at = np.where(pair[at] == key, pair_place[at], -1)
        at, row = np.concatenate([one[own], at]), np.concatenate([row, row[near]])
        key, n = np.unique((row * len(idf) + at)[at >= 0], return_counts=True)
        return key // max(1, len(idf)), key % max(1, len(idf)), n

    def run(batches):
        for batch in batches:
            for part in blocks.pieces(batch, batch.num_columns - 1, HELD_WORDS):
                row, at, n = terms(part.column(part.num_columns - 1))
                x = (np.log(n.astype(float)) + 1.0) * idf[at]
                w = x / np.sqrt(np.bincount(row, x * x, len(part)))[row]
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(part)))]), pa.int32())
                lists = (pa.ListArray.from_arrays(ends, pa.array(v, t)) for v, t in ((at, pa.int32()), (w, pa.float64())))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *lists], [*part.schema.names[:-1], "at", "w"])

    rows = blocks.spread(docs.select(id_col, *carry, text_col)).select(F.col(id_col).alias("id"), *carry, words(F.col(text_col), stop_words).alias("words"))
    carried = "".join(f", `{c}` {kinds[c]}" for c in carry)
    return rows.mapInArrow(run, f"id {kinds[id_col]}{carried}, at array<int>, w array<double>")


def weights(found: DataFrame, vocab: DataFrame) -> DataFrame:
    """(id, term, w) of vectors (id, at, w)."""
    places = vocab.select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("place"))
    at = found.select("id", F.explode(F.arrays_zip("at", "w")).alias("x")).select("id", "x.at", "x.w")
    return at.join(F.broadcast(places), F.col("at") == F.col("place")).select("id", "term", "w")


def fit(corpus: DataFrame, id_col: str, text_col: str, stop_words: tuple = STOP_WORDS, **options) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, weights) of a corpus; documents without terms count too."""
    path = scratch.folder(corpus.sparkSession, "vocabulary")
    vocabulary(corpus, text_col, stop_words=stop_words, **options).write.parquet(path)
    vocab = corpus.sparkSession.read.parquet(path)  # read more than once, counted once
    return vocab, weights(vectors(corpus, id_col, text_col, vocab, stop_words), vocab)


#: Rows in a block: a block of queries is spread out as a matrix, 128 times 20000 weights are 20 MB.
QUERY_BLOCK, CANDIDATE_BLOCK = 128, 4096
#: Queries whose blocks go to every task; each is some hundred bytes.
MOST_ASKED = 64 * QUERY_BLOCK
#: Words of texts whose vectors a task makes at once; a longer text is taken alone.
HELD_WORDS = 1 << 17


def best(queries: DataFrame, candidates: DataFrame, k: int, boost: float = 0.10, counts: tuple | None = None) -> DataFrame:
    """Ranks candidates for queries, both vectors (id, at, w, optional category, boosts): the
    product of weights, plus ``boost`` where the categories are equal and both sides allow it.

    Candidates are packed into blocks where they are, and ordered by category and strongest term into
    groups, each with the greatest weight of each of its terms. With them a query's weights bound
    what any candidate of the group can reach; groups below its k-th best score aren't scored. Candidates
    that share no term rank with 0, in the order of their ids. counts: as in blocks.pairs.
    """
    labelled = "category" in queries.columns and "category" in candidates.columns
    columns = "ids binary, first binary, at binary, w binary, category array<string>, boosts array<boolean>"
    extra = ["category", "boosts"] if labelled else []
    q, c = (df.select(F.col("id").cast("long").alias("id"), "at", "w", *extra) for df in (queries, candidates))
    found = blocks.pairs(
        blocks.packed(q, _sparse_block, columns, QUERY_BLOCK, gather=True), c, _grouped_block, f"{columns}, peak_first binary, peak_at binary, peak_w binary", CANDIDATE_BLOCK,
        q.count() <= MOST_ASKED, _products(boost), k, counts,
    )
    return top_k(found, k, F.desc(F.round("score", 9)), F.col("candidate_id")).select("query_id", "candidate_id", "rank", clamp01(F.col("score")).alias("score"))


def _sparse_block(rows):
    at, w = (rows.column(c).combine_chunks() for c in ("at", "w"))
    first = np.concatenate([[0], np.cumsum(np.diff(at.offsets.to_numpy()))])
    flat = [rows.column("id").to_numpy().astype("<i8"), first.astype("<i8"), at.flatten().to_numpy(zero_copy_only=False).astype("<i4"), w.flatten().to_numpy(zero_copy_only=False).astype("<f8")]
    labels = [rows.column(c).to_pylist() if c in rows.column_names else [] for c in ("category", "boosts")]
    yield *(x.tobytes() for x in flat), *labels


def _grouped_block(rows):
    """As _sparse_block, with rows of one category and strongest term side by side, and the
    greatest weight of each term in each group of blocks.GROUP rows."""
    rows = rows.combine_chunks()
    block = next(_sparse_block(rows))
    first, at, w = np.frombuffer(block[1], "<i8"), np.frombuffer(block[2], "<i4"), np.frombuffer(block[3], "<f8")
    filled, strongest = np.flatnonzero(np.diff(first)), np.full(len(rows), -1)
    strongest[filled] = at[np.lexsort((at, -w, np.repeat(np.arange(len(rows)), np.diff(first))))[first[filled]]]
    labels = [rows.column(c).to_pylist() if c in rows.column_names else [None] * len(rows) for c in ("category", "boosts")]
    order = sorted(range(len(rows)), key=lambda i: (labels[0][i] or "", labels[1][i] is False, strongest[i]))
    block = next(_sparse_block(rows.take(order)))
    first, at, w = np.frombuffer(block[1], "<i8"), np.frombuffer(block[2], "<i4").astype(np.int64), np.frombuffer(block[3], "<f8")
    group = np.repeat(np.arange(len(rows)) // blocks.GROUP, np.diff(first))
    by = np.lexsort((at, group))
    new = np.ones(len(by), bool)
    new[1:] = (group[by][1:] != group[by][:-1]) | (at[by][1:] != at[by][:-1])
    start = np.flatnonzero(new)
    peak = np.maximum.reduceat(w[by], start) if len(start) else w
    ends = np.searchsorted(group[by][start], np.arange(-(-len(rows) // blocks.GROUP) + 1))
    yield *block, ends.astype("<i8").tobytes(), at[by][start].astype("<i4").tobytes(), peak.astype("<f8").tobytes()


def _products(boost: float):
    def meet(q: dict, c: dict) -> tuple:
        (asked, qf, qa, qw), (ids, cf, ca, cw) = ([np.frombuffer(b[n], t) for n, t in (("ids", "<i8"), ("first", "<i8"), ("at", "<i4"), ("w", "<f8"))] for b in (q, c))
        pf, pa_, pw = (np.frombuffer(c[n], t) for n, t in (("peak_first", "<i8"), ("peak_at", "<i4"), ("peak_w", "<f8")))
        # the queries' terms only: a row of weights for each, and one of zeros for all others
        terms = np.unique(qa)
        spread = np.zeros((len(terms) + 1, len(asked)))
        spread[np.searchsorted(terms, qa), np.repeat(np.arange(len(asked)), np.diff(qf))] = qw

        def among(at):
            place = np.searchsorted(terms, at)
            return place, np.append(terms, -1)[place] == at

        place, known = among(ca)
        parts = [slice(i, min(i + blocks.GROUP, len(ids))) for i in range(0, len(ids), blocks.GROUP)]
        peak_place, peak_known = among(pa_)
        bound = np.zeros((len(asked), len(parts)))
        for g, (a, b) in enumerate(zip(pf[:-1], pf[1:])):
            near = peak_known[a:b]
            bound[:, g] = pw[a:b][near] @ spread[peak_place[a:b][near]]
        extra = None
        if q["category"] and c["category"]:
            name = {v: i for i, v in enumerate(dict.fromkeys(v for v in (*q["category"], *c["category"]) if v is not None))}
            qc, cc = (np.array([name.get(v, -1 - side) for v in b["category"]]) for side, b in enumerate((q, c)))
            qb, cb = (np.array([v is None or v for v in b["boosts"]], bool) for b in (q, c))
            extra = boost * ((qc[:, None] == cc[None, :]) & qb[:, None] & cb[None, :])
            bound += np.stack([extra[:, p].max(axis=1) for p in parts], axis=1)

        def score(own, g):
            out, mine = np.zeros((len(own), parts[g].stop - parts[g].start)), spread[:, own]
            for j in range(parts[g].start, parts[g].stop):
                s = slice(cf[j], cf[j + 1])
                near = known[s]
                if near.any():
                    out[:, j - parts[g].start] = cw[s][near] @ mine[place[s][near]]
            return out if extra is None else out + extra[own, parts[g]]

        return asked, [ids[p] for p in parts], bound, score

    return meet


def similarities(query_weights: DataFrame, doc_weights: DataFrame) -> DataFrame:
    """(query_id, candidate_id, sim) of pairs that share a term: an inverted-index join, for rare
    terms. A term that most documents have pairs nearly all of them: best() has no such join."""
    q = query_weights.select(F.col("id").alias("query_id"), "term", F.col("w").alias("wq"))
    d = doc_weights.select(F.col("id").alias("candidate_id"), "term", F.col("w").alias("wd"))
    return d.join(q, "term").groupBy("query_id", "candidate_id").agg(F.sum(F.col("wq") * F.col("wd")).alias("sim"))


def search(queries: DataFrame, candidates: DataFrame, sims: DataFrame, k: int, boost: float = 0.10) -> DataFrame:
    """Ranks candidates (candidate_id, optional category, boosts) for queries (query_id,
    optional category, boosts): sim, plus ``boost`` where the categories are equal and both
    sides allow it. Candidates that share no term rank with 0, in the order of their ids;
    only the first k of those (and the first k of each category) can be among the k best,
    so the rest needn't be paired with every query."""
    labelled = "category" in queries.columns and "category" in candidates.columns
    q = queries.select("query_id", *([F.col("category").alias("qc"), F.coalesce("boosts", F.lit(True)).alias("qb")] if labelled else []))
    c = candidates.select("candidate_id", *([F.col("category").alias("cc"), F.coalesce("boosts", F.lit(True)).alias("cb")] if labelled else []))
    by_rank = c.orderBy("candidate_id").limit(k) if not labelled else c.withColumn(
        "place", F.row_number().over(Window.partitionBy("cc", "cb").orderBy("candidate_id"))).where(F.col("place") <= k).drop("place")
    # pairs that share a term, and those few that can rank without sharing any
    some = sims.join(c, "candidate_id").join(q, "query_id")
    # k rows, or k of each category: a bounded side
    zero = q.crossJoin(F.broadcast(by_rank)).join(sims.select("query_id", "candidate_id"), ["query_id", "candidate_id"], "left_anti").withColumn("sim", F.lit(0.0))
    at = some.unionByName(zero)
    if labelled:
        at = at.withColumn("sim", F.col("sim") + F.when((F.col("qc") == F.col("cc")) & F.col("qb") & F.col("cb"), F.lit(boost)).otherwise(0.0))
    ranked = top_k(at, k, F.desc(F.round("sim", 9)), F.col("candidate_id"))
    return ranked.select("query_id", "candidate_id", "rank", clamp01(F.col("sim")).alias("score"))


def classifier(found: DataFrame, vocab: DataFrame, labels: DataFrame | None = None, c: float = 1.0, max_iter: int = 1000):
    """Multinomial logistic regression over TF-IDF rows, vectors (id, at, w) or weights (id,
    term, w), with labels (id, category); without labels, the vectors have a category each.

    Returns a function that gives such rows a predicted ``category``, null where a row has no term; weights
    become vectors. Vectors stay where they are: nothing is joined to them."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer

    size = vocab.count()
    train = _sparse(_listed(found, vocab) if labels is None else _listed(found, vocab).drop("category").join(labels.where("category is not null"), "id"), size)
    index = StringIndexer(inputCol="category", outputCol="label", stringOrderType="alphabetAsc").fit(train)
    n = train.count()
    # every partition sends a gradient in each iteration: as many as there are cores, however many files there are
    rows = index.transform(train).select("features", "label").coalesce(train.sparkSession.sparkContext.defaultParallelism)
    model = LogisticRegression(family="multinomial", regParam=1.0 / (c * max(1, n)), elasticNetParam=0.0, standardization=False, maxIter=max_iter).fit(rows)
    by_place, base, names = model.coefficientMatrix.toArray().T.copy(), model.interceptVector.toArray(), list(index.labels)

    def run(batches):
        for batch in batches:
            for part in blocks.pieces(batch, batch.schema.get_field_index("at"), HELD_WORDS // 4):
                at, w = (pc.fill_null(part.column(x), []) for x in ("at", "w"))
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(at).to_numpy(zero_copy_only=False))]).astype(np.int64)
                own = by_place[at.flatten().to_numpy(zero_copy_only=False)] * w.flatten().to_numpy(zero_copy_only=False)[:, None]
                filled = np.flatnonzero(np.diff(ends))
                found = np.full(len(part), -1)
                if len(filled):
                    found[filled] = (np.add.reduceat(own, ends[filled], axis=0) + base).argmax(axis=1)
                category = pa.array([None if i < 0 else names[i] for i in found.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, category], [*part.schema.names, "category"])

    def predict(rows):
        rows = _listed(rows, vocab)
        rows = rows.drop("category")
        return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", category string")

    return predict


def _listed(found: DataFrame, vocab: DataFrame) -> DataFrame:
    """Vectors (id, at, w) of weights (id, term, w); vectors as they are."""
    if "at" in found.columns:
        return found
    ids = vocab.select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("place"))
    at = found.join(F.broadcast(ids), "term").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "w"))).alias("x"))
    return at.select("id", F.col("x.place").alias("at"), F.col("x.w").alias("w"))


def _sparse(found: DataFrame, size: int) -> DataFrame:
    """(category, features) of the rows that have a term and a category. Parquet holds a vector as the struct
    that it is written as here, so no row passes through Python."""
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import StringType, StructField, StructType

    spark, path = found.sparkSession, scratch.folder(found.sparkSession, "features")
    sparse = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), F.col("at").cast("array<int>").alias("indices"), F.col("w").cast("array<double>").alias("values"))
    found.where((F.size("at") > 0) & F.col("category").isNotNull()).select("category", sparse.alias("features")).write.parquet(path)
    return spark.read.schema(StructType([StructField("category", StringType()), StructField("features", VectorUDT())])).parquet(path)
