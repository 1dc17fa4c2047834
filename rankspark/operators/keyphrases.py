"""Key phrases of texts by maximal marginal relevance."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import embedding
from .embedding import embed, hash_embedding  # noqa: F401 (embed: used by name from here)
from .tfidf import STOP_WORDS


def mmr(doc: np.ndarray, vectors: np.ndarray, n: int, diversity: float = 0.5) -> list[int]:
    """Maximal marginal relevance: the phrase most like the document first, then by
    (1 - diversity) likeness to it minus diversity times likeness to what is chosen."""
    if not len(vectors):
        return []
    near = vectors @ doc
    chosen, like = [int(np.argmax(near))], np.full(len(vectors), -np.inf)
    while len(chosen) < min(n, len(vectors)):
        like = np.maximum(like, vectors @ vectors[chosen[-1]])
        score = (1 - diversity) * near - diversity * like
        score[chosen] = -np.inf
        chosen.append(int(np.argmax(score)))
    return chosen


#: Phrases whose vectors are held at once.
BLOCK = 4096


def mmr_of(doc: np.ndarray, phrases: list[str], n: int, vectors, diversity: float = 0.5, block: int = BLOCK) -> list[int]:
    """mmr() of any number of phrases, with the vectors of one block at a time; ``vectors``
    embeds a list. Likeness to what is chosen only grows, so a score that is out of date is a
    bound, and only the phrases whose bound is the greatest are scored again."""
    if len(phrases) <= block:
        return mmr(doc, vectors(phrases), n, diversity)
    parts = range(0, len(phrases), block)
    near = np.concatenate([vectors(phrases[i : i + block]) @ doc for i in parts])
    first = int(np.argmax(near))
    chosen, taken = [first], vectors([phrases[first]])
    like = np.concatenate([vectors(phrases[i : i + block]) @ taken[0] for i in parts])
    heap = [(-s, i, 1) for i, s in enumerate(((1 - diversity) * near - diversity * like).tolist()) if i != first]
    heapq.heapify(heap)
    while heap and len(chosen) < n:
        _, i, seen = heapq.heappop(heap)
        if seen == len(chosen):
            chosen.append(i)
            taken = np.concatenate([taken, vectors([phrases[i]])])
        else:
            like[i] = max(like[i], float((taken[seen:] @ vectors([phrases[i]])[0]).max()))
            heapq.heappush(heap, (-((1 - diversity) * near[i] - diversity * like[i]), i, len(chosen)))
    return chosen


class Phrases:
    """All distinct phrases of one to three adjacent words of each of some lists (from the list ``first`` on), as
    hash_embedding() has them, but only their numbers that aren't zero: ``at`` and ``value``, five of each, by phrase."""

    def __init__(self, grams: embedding.Grams, first: int = 0):
        self.grams = grams
        row, own, pair = grams.row, grams.own, grams.pair
        ones = np.arange(np.searchsorted(row, first), len(own))
        twos = ones[pair[ones] >= 0]
        threes = twos[pair[twos + 1] >= 0] if len(twos) else twos
        kinds = (ones, row[ones] * grams.words + own[ones]), (twos, row[twos] * grams.pairs + pair[twos]), (threes, (row[threes] * grams.pairs + pair[threes]) * grams.words + own[threes + 2])
        starts = [places[np.unique(keys, return_index=True)[1]] for places, keys in kinds]
        start, length = np.concatenate(starts), np.repeat([1, 2, 3], [len(x) for x in starts])
        by = np.argsort(row[start], kind="stable")
        self.start, self.length, self.row = start[by], length[by], row[start[by]] - first
        long, longest = self.length > 1, self.length > 2
        second, third = self.start + long, self.start + 2 * longest
        words, pairs = (own[self.start], own[second], own[third]), (pair[self.start], pair[second])
        self.at = np.stack([grams.word_at[w] for w in words] + [grams.pair_at[p] for p in pairs])
        self.value = np.stack([grams.word_sign[w] for w in words] + [grams.pair_sign[p] for p in pairs])
        self.value[[1, 3]] *= long
        self.value[[2, 4]] *= longest
        # numbers in one cell add up before the length is taken
        square = 2.0 * self.length - 1
        for i in range(5):
            for j in range(i):
                square += 2 * self.value[i] * self.value[j] * (self.at[i] == self.at[j])
        self.value /= np.sqrt(square)

    def text(self, i: int) -> str:
        return " ".join(self.grams.flat[self.start[i] : self.start[i] + self.length[i]])

    def like(self, vectors: np.ndarray) -> np.ndarray:
        """Likeness of each phrase to the vector of its list."""
        flat, base = vectors.ravel(), self.row * vectors.shape[1]
        out = self.value[0] * flat[base + self.at[0]]
        for j in range(1, 5):
            out += self.value[j] * flat[base + self.at[j]]
        return out

    def most_like(self, vectors: np.ndarray, begin: int, end: int) -> np.ndarray:
        """Greatest likeness of the phrases from begin to end to any of the vectors, a column each."""
        out = np.empty(end - begin)
        for i in range(begin, end, BLOCK):
            of = slice(i, min(end, i + BLOCK))
            near = self.value[0, of, None] * vectors[self.at[0, of]]
            for j in range(1, 5):
                near += self.value[j, of, None] * vectors[self.at[j, of]]
            out[i - begin : of.stop - begin] = near.max(axis=1)
        return out


#: Phrases of a list that are scored again after each choice.
NEAREST = 384


def hashed_mmr(doc: np.ndarray, words: list[str], n: int, diversity: float = 0.5) -> list[str]:
    """mmr() of all phrases of ``words``, as hashed_mmr_of() chooses them."""
    return hashed_mmr_of(doc[None], Phrases(embedding.Grams([words], len(doc))), n, diversity)[0]


def hashed_mmr_of(docs: np.ndarray, phrases: Phrases, n: int, diversity: float = 0.5) -> list[list[str]]:
    """mmr() of the phrases of many lists, each with the vector of its document: one choice after the other, for
    all lists at once, without dense vectors of phrases. Scores are compared at nine places; a tie goes to the phrase that
    sorts first. Likeness to what is chosen only grows, so scores only fall: while one of a list's NEAREST best is above
    what its others had, the others aren't scored; else that list's phrases are all scored once more."""
    dim, out = docs.shape[1], [[] for _ in docs]
    bounds = np.searchsorted(phrases.row, np.arange(len(docs) + 1))
    size = np.diff(bounds)
    most_picks, width = np.minimum(size, n), int(min(NEAREST, size.max(initial=0)))
    if not width or n < 1:
        return out
    near, left, met = phrases.like(docs), np.ones(len(phrases.row), bool), np.zeros(len(docs), np.int64)
    near_of = np.zeros((len(docs), width), np.int64)
    open_, rest = np.zeros((len(docs), width), bool), np.full(len(docs), -np.inf)

    def first(places: np.ndarray) -> int:
        return int(places[0]) if len(places) == 1 else min(places.tolist(), key=phrases.text)

    def vector(i: int) -> np.ndarray:
        return np.bincount(phrases.at[:, i], phrases.value[:, i], dim)

    def take(d: int, i: int) -> None:
        out[d].append(i)
        left[i] = False

    def narrow(d: int) -> None:
        """The list's nearest phrases, by scores that ``like`` has up to date."""
        of = slice(bounds[d], bounds[d + 1])
        score = np.where(left[of], (1 - diversity) * near[of] - diversity * like[of], -np.inf)
        by = np.argpartition(-score, width - 1) if len(score) > width else np.arange(len(score))
        rest[d] = np.round(score[by[width:]].max(initial=-np.inf), 9)
        own = bounds[d] + by[:width]
        near_of[d, : len(own)], open_[d] = own, False
        open_[d, : len(own)] = left[own]

    def all_again(d: int) -> None:
        """The next choice from all phrases of the list."""
        of = slice(bounds[d], bounds[d + 1])

        def meet() -> None:
            new = np.stack([vector(i) for i in out[d][met[d] :]], axis=1)
            like[of], met[d] = np.maximum(like[of], phrases.most_like(new, of.start, of.stop)), len(out[d])

        if met[d] < len(out[d]):
            meet()
        found = np.round(np.where(left[of], (1 - diversity) * near[of] - diversity * like[of], -np.inf), 9)
        take(d, first(bounds[d] + np.flatnonzero(found == found.max())))
        meet()
        narrow(d)

    # the first choice: the most like the document
    full = np.flatnonzero(size)
    found = np.round(near, 9)
    ties = np.flatnonzero(found == np.repeat(np.maximum.reduceat(found, bounds[full]), size[full]))
    for d, places in zip(full.tolist(), np.split(ties, np.searchsorted(ties, bounds[full[1:]]))):
        take(d, first(places))
    taken = np.zeros((len(docs), dim))
    for d in full.tolist():
        taken[d] = vector(out[d][0])
    like = phrases.like(taken)
    met[full] = 1
    for d in full.tolist():
        narrow(d)
    cell = phrases.at[:, near_of] + (np.arange(len(docs)) * dim)[:, None]
    value, own_near, own_like = phrases.value[:, near_of], near[near_of], like[near_of]
    for turn in range(1, int(most_picks.max())):
        found = np.round(np.where(open_, (1 - diversity) * own_near - diversity * own_like, -np.inf), 9)
        most = found.max(axis=1)
        live = turn < most_picks
        again = live & (most <= rest)
        best = found == most[:, None]
        place, many = best.argmax(axis=1), best.sum(axis=1) > 1
        chosen = np.flatnonzero(live & ~again)
        for d in chosen[many[chosen]].tolist():
            own = np.flatnonzero(best[d])
            place[d] = own[np.flatnonzero(near_of[d, own] == first(near_of[d, own]))[0]]
        for d, i in zip(chosen.tolist(), near_of[chosen, place[chosen]].tolist()):
            take(d, i)
        open_[chosen, place[chosen]] = False
        taken[:] = 0
        for j in range(5):
            taken.ravel()[cell[j, chosen, place[chosen]]] += value[j, chosen, place[chosen]]
        flat, new = taken.ravel(), np.zeros_like(own_near)
        for j in range(5):
            new += value[j] * flat[cell[j]]
        own_like = np.where((live & ~again)[:, None], np.maximum(own_like, new), own_like)
        for d in np.flatnonzero(again).tolist():
            all_again(d)
            own = near_of[d]
            cell[:, d], value[:, d], own_near[d], own_like[d] = phrases.at[:, own] + d * dim, phrases.value[:, own], near[own], like[own]
    return [[phrases.text(i) for i in own] for own in out]


#: Bounds of the texts whose phrases are chosen together: texts, and characters (a longer text is alone).
MOST_TEXTS, MOST_CHARS = 96, 1 << 18


def hashed_phrases(texts: list[str], words: list[list[str]], n: int, dim: int) -> list[list[str]]:
    """The phrases of each text, by their hashed embeddings."""
    out, held, chars = [], 0, 0
    for i, text in enumerate(texts):
        if i > held and (i - held == MOST_TEXTS or chars + len(text) > MOST_CHARS):
            out, held, chars = out + _hashed_phrases(texts[held:i], words[held:i], n, dim), i, 0
        chars += len(text)
    return out + _hashed_phrases(texts[held:], words[held:], n, dim)


def _hashed_phrases(texts: list[str], words: list[list[str]], n: int, dim: int) -> list[list[str]]:
    grams = embedding.Grams([embedding.hashed_words(t) for t in texts] + words, dim)
    return hashed_mmr_of(grams.embeddings(len(texts)), Phrases(grams, len(texts)), n)


def keyphrases(docs: DataFrame, text: str = "text", name: str | None = None, top: int = 15, embedder=hash_embedding, dim: int = 256) -> DataFrame:
    """``docs`` with ``phrases``: up to ``top`` phrases of one to three words, without junk
    and without those that mostly repeat the person's name. Only a text's words go to Python."""
    words = F.filter(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)), lambda w: ~w.isin(*STOP_WORDS))
    model = embedder if isinstance(embedder, embedding.Embedder) else embedding.one_by_one(embedder)

    def phrases_of(value: str, found: list[str]) -> list[str]:
        encode = embedding.opened(model)
        vectors = lambda t: np.array(embedding.encoded(model, encode, t, dim), float)
        every = sorted({" ".join(found[i : i + k]) for k in (1, 2, 3) for i in range(len(found) - k + 1)})
        return [every[i] for i in mmr_of(vectors([value])[0], every, top + 10, vectors)]

    @F.arrow_udf("array<string>")
    def choose(texts: pa.Array, found: pa.Array) -> pa.Array:
        values = [t or "" for t in texts.to_pylist()]
        ends = np.cumsum(pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False)).tolist()
        flat = found.flatten().to_numpy(zero_copy_only=False).tolist()
        lists = [flat[i:j] for i, j in zip([0, *ends], ends)]
        every = hashed_phrases(values, lists, top + 10, dim) if embedder is hash_embedding else list(map(phrases_of, values, lists))
        return pa.array(every, pa.list_(pa.string()))

    at = docs.withColumn("__names", X.name_tokens(F.col(name) if name else F.lit(None).cast("string"))).withColumn("__found", choose(F.col(text), words))
    # what a phrase is judged by is made once: in a lambda Spark evaluates an expression wherever it stands
    parts = lambda p: F.when(F.size("__names") > 0, X.tokens(F.lower(p)))
    judged = F.transform("__found", lambda p: F.struct(p.alias("phrase"), X.strip(p).alias("bare"), F.lower(X.strip(p)).alias("low"), parts(p).alias("parts")))
    kept = F.filter(judged, lambda p: ~X.is_junk(p["bare"], p["low"]) & ~X.mostly_of(p["parts"], F.col("__names")))
    return at.withColumn("phrases", F.slice(F.transform(kept, lambda p: p["phrase"]), 1, top)).drop("__found", "__names")
