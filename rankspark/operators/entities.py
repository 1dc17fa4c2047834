"""Organisations and persons: gazetteer phrases, shape rules, pluggable models, overlaps."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas

#: Two title-case Latin words, or two to six Latin capitals.
TITLE_PAIR = r"(?<![\p{L}\p{N}_])[A-Z][a-z]+[ \t][A-Z][a-z]+(?![\p{L}\p{N}_])"
ALL_CAPS = r"(?<![\p{L}\p{N}_])[A-Z]{2,6}(?![\p{L}\p{N}_])"


def keep_longest(entities: list) -> list:
    """Entities (dicts) in order of start, longer first, rules before models; each goes that
    overlaps one kept before by over half of the shorter of both."""
    kept: list = []
    for e in sorted(entities, key=lambda e: (e["start"], e["start"] - e["end"], not e["source"].startswith("rule"))):
        clash = False
        for k in kept:
            both = min(e["end"], k["end"]) - max(e["start"], k["start"])
            if both > 0 and both > 0.5 * min(e["end"] - e["start"], k["end"] - k["start"]):
                clash = True
                break
        if not clash:
            kept.append(e)
    return kept


def folded(text: str) -> str:
    """Lower case, character by character, so that places stay the same."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def automaton(phrases):
    """An Aho-Corasick automaton of the phrases: its time for a text doesn't depend on their number."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for p in {folded(p) for p in phrases if p}:
        found.add_word(p, len(p))
    found.make_automaton()
    return found


_WORD = re.compile(r"\w")


def named(names, text: str) -> list[tuple[int, int]]:
    """(start, end) of the phrases of an automaton in a text, as whole words: the leftmost first, the
    longest of those that start together, none that overlaps one before."""
    if not len(names):
        return []
    low, found = folded(text), []
    for last, n in names.iter(low):
        start, end = last + 1 - n, last + 1
        if not (start and _WORD.match(low[start - 1])) and not (end < len(low) and _WORD.match(low[end])):
            found.append((start, end))
    out, free = [], 0
    for start, end in sorted(found, key=lambda f: (f[0], -f[1])):
        if start >= free:
            out.append((start, end))
            free = end
    return out


def extract(docs: DataFrame, phrases: list[str], text: str = "text", model=None) -> DataFrame:
    """``docs`` with ``entities``, an array of ENTITY structs.

    ``phrases`` is a gazetteer, broadcast and built once for each worker into an automaton (some
    hundred bytes a name). ``model`` maps a text to a list of entity dicts, or is a tuple of such
    models, such as one for each language, whose entities are united; they run in Arrow batches.
    """
    listed = docs.sparkSession.sparkContext.broadcast(tuple(dict.fromkeys(phrases)))
    models = model if isinstance(model, (list, tuple)) else [model] if model else []
    shapes = [re.compile(p.replace(r"[\p{L}\p{N}_]", r"\w")) for p in (TITLE_PAIR, ALL_CAPS)]

    def find(names, value: str | None) -> list:
        if not value or not value.strip():
            return []
        found = [e for m in models for e in m(value)]
        found += [{"text": value[s:e], "label": "ORG", "start": s, "end": e, "source": "rule_phrases"} for s, e in named(names, value)]
        for shape in shapes:
            found += [{"text": m.group(), "label": "ORG", "start": m.start(), "end": m.end(), "source": "rule_shapes"} for m in shape.finditer(value)]
        return keep_longest(found)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = automaton(listed.value)
        for values in batches:
            yield pd.Series([[tuple(e[k] for k in ("text", "label", "start", "end", "source")) for e in find(names, v)] for v in values])

    return docs.withColumn("entities", F.pandas_udf(run, T.ArrayType(schemas.ENTITY))(F.col(text)))


def persons(text: Column, model) -> Column:
    """Texts of the persons that a model, or each of a tuple of models in turn, finds."""
    models = model if isinstance(model, (list, tuple)) else [model]

    @F.pandas_udf("array<string>")
    def find(values: pd.Series) -> pd.Series:
        return pd.Series([[e["text"] for m in models for e in m(v) if e["label"] in ("PER", "PERSON")] if v else [] for v in values])

    return find(text)


def organisations(entities: Column) -> Column:
    return F.transform(F.filter(entities, lambda e: e["label"] == "ORG"), lambda e: e["text"])
