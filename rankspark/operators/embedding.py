"""Embeddings in batches: one model for each worker, calls bounded by what padding costs.

An embedder is a function (texts, dim) -> matrix, or an Embedder that opens a model once for each
Python worker and says how large a call may be. The texts of an Arrow batch are sorted by length and cut
where a call would have too many rows or too many padded characters (rows times the longest), so
that a long text doesn't pad many short ones. Equal texts of a batch are embedded once. Results don't
depend on how calls are cut, as far as the model's don't.
"""

from __future__ import annotations

import hashlib
import sys
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Embedder:
    """open: makes encode(texts, dim) -> (len(texts), dim) numbers, once for each worker and ``name``.
    most_rows, most_cost: bounds of one call; a longer text is a call of its own. most_chars: what the
    model reads of a text, None for all of it."""

    open: Callable[[], Callable]
    name: str
    most_rows: int = 64
    most_cost: int = 1 << 17
    most_chars: int | None = None


def calls(lengths: list[int], most_rows: int, most_cost: int) -> Iterator[list[int]]:
    """Places of the texts of each call, the longest first."""
    held: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if held and (len(held) == most_rows or (len(held) + 1) * max(1, lengths[held[0]]) > most_cost):
            yield held
            held = []
        held.append(i)
    if held:
        yield held


def opened(embedder: Embedder) -> Callable:
    """The worker's model, opened by its first task."""
    kept = sys.__dict__.setdefault("_rankspark_models", {})
    if embedder.name not in kept:
        kept[embedder.name] = embedder.open()
    return kept[embedder.name]


def encoded(embedder: Embedder, encode: Callable, texts: list, dim: int) -> list:
    """A float32 vector for each text, None for None."""
    place = {t: i for i, t in enumerate(dict.fromkeys(t for t in texts if t is not None))}
    every = [t if embedder.most_chars is None else t[: embedder.most_chars] for t in place]
    out = np.zeros((len(every), dim), np.float32)
    for own in calls([len(t) for t in every], embedder.most_rows, embedder.most_cost):
        got = np.asarray(encode([every[i] for i in own], dim), np.float32)
        if got.shape != (len(own), dim):
            raise ValueError(f"the model {embedder.name} gave {got.shape} numbers for {len(own)} texts of {dim}")
        out[own] = got
    return [None if t is None else out[place[t]] for t in texts]


def embed(c: Column, dim: int, embedder) -> Column:
    """array<float> of each text; null stays null."""
    if not isinstance(embedder, Embedder):
        embedder = one_by_one(embedder)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = opened(embedder)
        for values in batches:
            yield pd.Series(encoded(embedder, encode, values.tolist(), dim))

    return F.pandas_udf(run, "array<float>")(c)


def one_by_one(function: Callable) -> Embedder:
    """An Embedder of a function (text, dim) -> vector."""
    name = f"{getattr(function, '__module__', '')}.{getattr(function, '__qualname__', repr(function))}"
    return Embedder(lambda: lambda texts, dim: np.array([function(t, dim) for t in texts]).reshape(len(texts), dim), name)


# --- the offline stand-in -------------------------------------------------------------------


def _hashes(grams) -> np.ndarray:
    """64 bits of each."""
    empty, found = hashlib.blake2b(digest_size=8).copy, []
    for gram in grams:
        own = empty()
        own.update(gram)
        found.append(own.digest())
    return np.frombuffer(b"".join(found), "<u8").astype(np.uint64)


def cells(hashes: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Where and with which sign each hash counts in a vector."""
    return (hashes % np.uint64(dim)).astype(np.int64), np.where(hashes >> np.uint64(63), 1.0, -1.0)


class Grams:
    """The words of many lists, and the pairs of words that are adjacent in a list, numbered: a word or a pair
    that several lists have is hashed once. Of each word in order: ``own`` (its number), ``row`` (its list) and ``pair``
    (the number of the pair that begins there, or -1, which counts nothing)."""

    def __init__(self, lists: list[list[str]], dim: int):
        self.dim, self.flat = dim, [w for words in lists for w in words]
        number = defaultdict(count().__next__)
        self.own = np.fromiter(map(number.__getitem__, self.flat), np.int64, len(self.flat))
        names = [w.encode() for w in number]
        self.row = np.repeat(np.arange(len(lists)), [len(words) for words in lists])
        begins = np.flatnonzero(self.row[1:] == self.row[:-1])
        pairs, own_pair = np.unique(self.own[begins] * len(names) + self.own[begins + 1], return_inverse=True)
        self.pair = np.full(len(self.flat), -1)
        self.pair[begins] = own_pair
        self.words, self.pairs = len(names), len(pairs)
        self.word_at, self.word_sign = cells(_hashes(names), dim)
        first, second = (x.tolist() for x in np.divmod(pairs, max(1, len(names))))
        spaced = [w + b" " for w in names]
        hashes = _hashes([spaced[a] + names[b] for a, b in zip(first, second)])
        self.pair_at, self.pair_sign = (np.append(x, 0) for x in cells(hashes, dim))

    def embeddings(self, n: int) -> np.ndarray:
        """hash_embedding() of the first n lists."""
        last = np.searchsorted(self.row, n)
        row, own, pair = self.row[:last] * self.dim, self.own[:last], self.pair[:last]
        at = np.concatenate([row + self.word_at[own], row + self.pair_at[pair]])
        out = np.bincount(at, np.concatenate([self.word_sign[own], self.pair_sign[pair]]), n * self.dim).reshape(n, self.dim)
        size = np.sqrt((out * out).sum(axis=1))
        return out / np.where(size > 0, size, 1.0)[:, None]


def hashed_words(text: str) -> list[str]:
    return text.lower().split()


def hash_embedding(text: str, dim: int = 1024) -> np.ndarray:
    """Unit vector of hashed words and word pairs; an offline stand-in for a model."""
    words = [w.encode() for w in hashed_words(text)]
    at, sign = cells(_hashes(words + [a + b" " + b for a, b in zip(words, words[1:])]), dim)
    out = np.bincount(at, sign, dim)
    size = np.linalg.norm(out)
    return out / size if size else out
