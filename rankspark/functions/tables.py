"""Table functions for SQL: date ranges and skill items of a text, one row each.

    tables.register(spark)
    spark.sql("SELECT id, d.* FROM lines, LATERAL date_ranges(text) d")

They give what the expressions of functions.text give as arrays; those are faster, as they stay in the
JVM. These are for SQL that has no arrays to write.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import text as X


def _compiled(pattern: str) -> re.Pattern:
    r"""A pattern of functions.text, whose \s and \d are ASCII and whose letters fold in any script."""
    return re.compile(pattern.replace(r"\s", r"[ \t\n\x0b\f\r]").replace(r"\d", "[0-9]"), re.I)


_RANGE = _compiled(f"({X.DATE}){X.RANGE_DASH}({X.DATE}|{X.PRESENT})")
_SINGLE, _PRESENT = _compiled(X.DATE), _compiled(X.PRESENT)
_BULLET = re.compile(rf"^\s*[{X.SKILL_BULLETS}]\s*")
_CATEGORY, _SPLIT, _NUMBER = re.compile(X.CATEGORY), re.compile(X.ITEM_SPLIT), re.compile("|".join(X.SKILL_NUMBERS))


def date_ranges(text: str) -> list[tuple[str | None, str]]:
    """(start, end) of each range, then (None, date) of each date outside ranges."""

    def end(value: str) -> str:
        return "present" if _PRESENT.match(value.strip().lower()) else value.strip()

    ranges = [(m[1].strip(), end(m[2])) for m in _RANGE.finditer(text)]
    return ranges + [(None, m[0].strip()) for m in _SINGLE.finditer(_RANGE.sub("\0", text))]


def split_items(text: str) -> list[str]:
    """Items between , ; | outside brackets; items with double spaces are split there too."""
    items, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        if ch in "([{":
            depth += 1
        elif ch in ")]}":
            depth = max(0, depth - 1)
        elif ch in ",;|" and not depth:
            items.append(text[start:i])
            start = i + 1
    items.append(text[start:])
    parts = [p for item in items for p in (_SPLIT.split(item) if "  " in item else [item])]
    return [p.strip().strip(".") for p in parts if p.strip()]


def skill_items(text: str) -> list[tuple[str, bool]]:
    """(item, noise) of a line without its bullet and category."""
    line = _BULLET.sub("", text.strip())
    found = _CATEGORY.match(line)
    return [(item, is_noise(item)) for item in split_items(found[2] if found else line)]


def is_noise(item: str) -> bool:
    low = item.strip().lower()
    return not 2 <= len(item) <= 60 or bool(_NUMBER.search(item)) or low in X.SKILL_STOPS or any(part in low for part in X.SKILL_CONTACTS)


@udtf(returnType="pos int, start string, end string")
class DateRanges:
    def eval(self, text: str):
        for i, (start, end) in enumerate(date_ranges(text) if text is not None else ()):
            yield i, start, end


@udtf(returnType="pos int, item string, noise boolean")
class SkillItems:
    def eval(self, text: str):
        for i, (item, noise) in enumerate(skill_items(text) if text is not None else ()):
            yield i, item, noise


def register(spark: SparkSession) -> None:
    """Makes date_ranges(text) and skill_items(text) known to the session's SQL."""
    spark.udtf.register("date_ranges", DateRanges)
    spark.udtf.register("skill_items", SkillItems)
