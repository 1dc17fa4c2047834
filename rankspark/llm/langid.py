"""Language identification by hierarchical discrimination.

A text's bigrams and trigrams of bytes (lower case) are hashed to one vector. Linear
support vector machines, one against the rest, choose the language family; within it,
one-versus-one machines separate the related languages by votes.

The machines are fitted on a bounded sample of labelled rows (SAMPLE_ROWS in all, drawn by
a hash of the id, the same for each language); every whole text is predicted.

Defined results: `und` with score 0 for a null text, a text without a letter, or where
nothing could be learned. A null id counts as an empty one. Rows that repeat get equal
results. An empty table gives an empty table. Other columns pass through untouched; the
names of the two results can be chosen, so that they don't take the place of any.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, spare

UNKNOWN = "und"
DIMENSION = 4096
#: Upper bound of labelled rows that reach the driver, as hashed vectors (8 KB each).
SAMPLE_ROWS = 2500
#: Language families by ISO 639-1 code. Other codes are a family of their own.
FAMILIES = {
    "germanic": "af da de en is nb nl nn no sv",
    "romance": "ca es fr gl it pt ro",
    "slavic": "be bg cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr uz",
    "indic": "bn gu hi mr ne pa ur",
    "semitic": "ar he mt",
    "malay": "id ms tl",
    "sinitic": "zh",
}


def family(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((name for name, codes in FAMILIES.items() if code in codes.split()), code)


def vector(text: str) -> np.ndarray:
    """Square roots of hashed bigram and trigram counts, of length one, and a constant."""
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(257) + b[1:]
    three = two[:-1] * np.uint32(257) + b[2:] + np.uint32(1 << 25)
    n = np.zeros(DIMENSION + 1)
    for grams in (two, three):
        n[:DIMENSION] += np.bincount((grams * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMENSION)
    n = np.sqrt(n)
    n /= np.linalg.norm(n)
    n[DIMENSION] = 1.0
    return n.astype(np.float32)


def machine(x: np.ndarray, positive: np.ndarray, cost: float = 10.0, epochs: int = 30, seed: int = 7) -> np.ndarray:
    """Weights of a linear support vector machine (squared hinge loss) by dual coordinate descent."""
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    alpha, w = np.zeros(len(y)), np.zeros(x.shape[1], np.float32)
    square = np.einsum("ij,ij->i", x, x) + 0.5 / cost
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(y)):
            gradient = y[i] * float(x[i] @ w) - 1 + alpha[i] * 0.5 / cost
            if alpha[i] == 0 and gradient >= 0:
                continue
            most = max(most, abs(gradient))
            now = max(0.0, alpha[i] - gradient / square[i])
            w += np.float32((now - alpha[i]) * y[i]) * x[i]
            alpha[i] = now
        if most < 0.01:
            break
    return w


def train(x: np.ndarray, langs: list[str]) -> dict:
    """Families, their languages, and the weights of all machines as columns."""
    of = np.array(langs)
    families = sorted({family(v) for v in langs})
    kin = {f: sorted({v for v in langs if family(v) == f}) for f in families}
    own = np.array([family(v) for v in langs])
    first = [machine(x, own == f) if len(families) > 1 else np.zeros(x.shape[1], np.float32) for f in families]
    pairs, second = [], []
    for f in families:
        for a, b in combinations(kin[f], 2):
            rows = (of == a) | (of == b)
            pairs.append((f, kin[f].index(a), kin[f].index(b)))
            second.append(machine(x[rows], of[rows] == a))
    return {"families": families, "kin": kin, "pairs": pairs, "weights": np.stack(first + second, axis=1)}


def decide(model: dict, x: np.ndarray) -> list[tuple[str, float]]:
    margins = x @ model["weights"]
    families, out = model["families"], []
    for row in margins.astype(float):
        at = row[: len(families)]
        p = np.exp(4 * (at - at.max()))
        p /= p.sum()
        f = families[int(at.argmax())]
        kin = model["kin"][f]
        votes, sure = np.zeros(len(kin)), np.zeros(len(kin))
        for (g, a, b), m in zip(model["pairs"], row[len(families) :]):
            if g == f:
                q = 1 / (1 + np.exp(-4 * np.clip(m, -20, 20)))
                votes[a if m >= 0 else b] += 1
                sure[a] += q
                sure[b] += 1 - q
        best = int(np.lexsort((sure, votes))[-1])
        out.append((kin[best], float(p.max() * (sure[best] / (len(kin) - 1) if len(kin) > 1 else 1.0))))
    return out


def held_out(id_: Column, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % folds == 0


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> dict | None:
    """The model, learned from texts and languages of rows that aren't held out."""
    usable = docs.where(F.col(text_col).rlike("\\p{L}") & F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)))
    sizes = {r[0]: r[1] for r in usable.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(rows).collect()}  # the most frequent languages
    if not sizes:
        return None
    share = max(1, rows // len(sizes))
    # a row is in the sample if its draw is under its language's rate
    rate = F.element_at(F.create_map(*[F.lit(v) for pair in ((k, min(1.0, share / n)) for k, n in sizes.items()) for v in pair]), F.col(lang_col))
    draw = F.pmod(F.xxhash64(F.lit("langid"), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)

    def run(batches):
        for batch in batches:
            got = [vector(t.as_py()).astype(np.float16).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(got, pa.binary()), batch.column(2)], ["lang", "x", "draw"])

    chosen = usable.where(draw < rate).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), draw.alias("draw"))
    # about ``rows``; the bound holds too where many rows share an id, and so a draw
    found = chosen.mapInArrow(run, "lang string, x binary, draw double").orderBy("draw", "lang", "x").limit(2 * rows).collect()
    found.sort(key=lambda r: (r[0], r[1]))
    if not found:
        return None
    x, langs = np.stack([np.frombuffer(r[1], np.float16).astype(np.float32) for r in found]), [r[0] for r in found]
    del found
    return train(x, langs)


def predict(docs: DataFrame, model: dict | None, text_col: str = "text", names: tuple[str, str] = ("__lang", "__score")) -> DataFrame:
    """``docs`` with the predicted language and its score, which take the place of columns of
    these names. The rows stay where they are."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop(*names)
    letters = spare(docs.columns, "__letters")[0]
    at = docs.withColumn(letters, F.coalesce(F.col(f"`{text_col}`").rlike("\\p{L}"), F.lit(False)))
    text_at, letters_at = at.columns.index(text_col), len(at.columns) - 1
    schema = docs.schema
    columns = [f.name for f in schema] + list(names)

    def run(batches):
        for batch in batches:
            texts = [t.as_py() if ok.as_py() else None for t, ok in zip(batch.column(text_at), batch.column(letters_at))]
            known = [i for i, t in enumerate(texts) if t is not None and model]
            lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if known:
                for i, (a, b) in zip(known, decide(model, np.stack([vector(texts[i]) for i in known]))):
                    lang[i], score[i] = a, min(1.0, max(0.0, b))
            yield pa.RecordBatch.from_arrays([*batch.columns[:letters_at], pa.array(lang), pa.array(score, pa.float64())], columns)

    return at.mapInArrow(run, T.StructType([*schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", names: tuple[str, str] = ("__lang", "__score")) -> DataFrame:
    """``docs`` with __lang and __score, by a model learned from ``docs`` itself."""
    return predict(docs, fit(docs, id_col, text_col, lang_col), text_col, names)


def in_a_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without those predicted `und`, in the columns of ``docs``."""
    lang, score = spare(docs.columns, "__lang", "__score")
    return identify(docs, id_col, text_col, lang_col, (lang, score)).where(F.col(lang) != UNKNOWN).drop(lang, score)
