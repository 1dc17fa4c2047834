"""Section headers by fuzzy match, and the sections that lines belong to."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, tokens

# --- fixed values: header aliases of each section, the bar of a match -------------------
ALIASES = {
    "experience": (
        "опыт работы", "опыт", "experience", "work experience", "work history", "профессиональный опыт", "трудовой опыт", "профессиональная деятельность",
        "карьера", "employment", "employment history", "professional experience", "professional background", "career", "стаж работы", "стаж", "трудовой стаж",
        "профессиональный стаж", "опыт работы и достижения", "опыт и достижения", "experience and achievements", "experience & achievements",
    ),
    "education": ("образование", "education", "обучение", "academic background", "academic experience", "degree"),
    "skills": (
        "навыки", "skills", "ключевые навыки", "стек", "stack", "технологии", "technical skills", "hard skills", "skills & technologies", "technologies",
        "key skills", "highlights", "highlights & skills",
    ),
    "projects": ("проекты", "projects", "pet projects", "pet проекты", "selected projects", "personal projects"),
    "languages": ("языки", "languages", "знание языков"),
    "about": ("о себе", "summary", "profile", "профиль", "about me", "обо мне"),
    "contacts": ("контакты", "contacts", "контактная информация"),
}
BAR = 85
LONGEST_HEADER = 40
# ---------------------------------------------------------------------------------------


class Patterns:
    """Longest common subsequences of a text with many patterns at once, bit by bit: a pattern has a bit
    for each character in one long integer, and a bit of guard above, which stops carries."""

    def __init__(self, patterns: list[str]):
        self.patterns, self.at, self.of, self.body = patterns, [], {}, 0
        base = 0
        for p in patterns:
            self.at.append(base)
            for i, c in enumerate(p):
                self.of[c] = self.of.get(c, 0) | 1 << base + i
            self.body |= ((1 << len(p)) - 1) << base
            base += len(p) + 1

    def lengths(self, text: str) -> list[int]:
        v = self.body
        for c in text:
            u = v & self.of.get(c, 0)
            v = ((v + u) | (v - u)) & self.body
        return [len(p) - (v >> base & (1 << len(p)) - 1).bit_count() for p, base in zip(self.patterns, self.at)]


def indel_ratio(a: str, b: str) -> float:
    """200 LCS / (len a + len b): similarity under insertions and deletions. Two empty
    strings are equal."""
    return 200.0 * Patterns([a]).lengths(b)[0] / (len(a) + len(b)) if a or b else 100.0


def indel(a: Column, b: Column) -> Column:
    """indel_ratio of two columns, in Arrow batches."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if u is None or v is None else indel_ratio(u, v) for u, v in zip(x, y)], dtype="float64")

    return ratio(a, b)


_SECTIONS = [section for section, aliases in ALIASES.items() for _ in aliases]
_HEADERS = Patterns([alias for aliases in ALIASES.values() for alias in aliases])


def closest_section(text: str) -> str | None:
    """The section of the best alias, the first of equally good ones, if it reaches the bar."""
    ratios = [200.0 * n / (len(text) + len(alias)) for n, alias in zip(_HEADERS.lengths(text), _HEADERS.patterns)]
    best = max(ratios)
    return _SECTIONS[ratios.index(best)] if best >= BAR else None


def is_long(text: Column) -> Column:
    """Longer than a header without its outer white space: one look at the text's beginning tells."""
    return text.rlike(rf"(?Us)\S.{{{LONGEST_HEADER - 1},}}?\S")


def may_be_header(text: Column, size: Column, bold: Column, body: Column) -> Column:
    """Short, and larger than the body, bold, or in upper case with five words at most."""
    t = strip(text)
    upper = (F.upper(t) == t) & (F.lower(t) != t) & (F.size(tokens(t)) <= 5)
    return (t != "") & (F.length(t) <= LONGEST_HEADER) & ((size >= body + 1.0) | bold | upper)


def closest(text: Column) -> Column:
    """closest_section() of a column; null stays null. Each text of an Arrow batch is looked up once."""

    @F.pandas_udf("string")
    def find(values: pd.Series) -> pd.Series:
        found = {t: closest_section(t) for t in set(values.dropna())}
        return pd.Series([found.get(t) for t in values], dtype=object)

    return find(text)


def headers(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``lines`` with ``header``: the section that a line is the header of, or null. Of lines that
    can't be headers only a null goes to the fuzzy match; nothing is joined."""
    at = lines.withColumn("__body", F.median("max_font_size").over(Window.partitionBy(doc)))
    norm = strip(F.regexp_replace(F.lower(strip(F.col("text"))), ":+$", ""))
    norm = F.when(may_be_header(F.col("text"), F.col("max_font_size"), F.col("is_bold"), F.col("__body")), norm)
    norm = F.when(~is_long(F.col("text")), norm)
    return at.withColumn("header", closest(norm)).drop("__body")


def sections(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Lines with their ``section``: the last header's, `about` before any; headers go."""
    return placed(lines, doc).where("header is null").drop("header")


def placed(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """All lines with ``header`` and ``section``."""
    return carry_forward(headers(lines, doc), doc)


def carry_forward(lines: DataFrame, doc: str = "doc_id", order: str = "line_no", initial: str = "about") -> DataFrame:
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.coalesce(F.last("header", ignorenulls=True).over(w), F.lit(initial)))
