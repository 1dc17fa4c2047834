"""Exact dedup by two-pass Bloom filtering.

Pass one marks the hashes that may repeat in a Bloom filter: tasks build bitmaps of their
own rows, and only the bitmaps shuffle. Pass two tests each row; a row whose hash surely
occurs once passes straight through, and only the rest shuffle to be grouped by the whole
SHA-256. The filter decides where a row goes, never whether it stays.

Defined results: a null text counts as empty, and empty texts equal each other. White-space
runs ([ \\t-\\r]+) count as one space; nothing is trimmed. Of rows that tie on the id too
(repeated rows, null ids), one stays. Ids that aren't null come before null. An empty
table gives an empty table. Other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_FILTER_BITS, SPACE, cut, filter_blocks, maybe_in, maybe_repeated, membership_filter, repeat_filter, whole


def normalised_sha(text: Column) -> Column:
    """SHA-256 (lower-case hex) of the text with white-space runs as one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), 256)


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    The digests (id and hash, no text) are written once, so that both passes see the same
    rows and read the texts once. most_bits: of a filter; more rows than it holds take more
    filters, one after the other.
    """
    digest = cut(docs.select(F.col(id_col).alias("id"), normalised_sha(F.col(text_col)).alias("text_sha256"), F.monotonically_increasing_id().alias("uid")), "digests")
    tested = maybe_repeated(digest, F.col("text_sha256"), most_bits)
    alone = tested.where("not __maybe").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    doubt = tested.where("__maybe").drop("__maybe")
    # written, so that both sides of the join are exchanges and a hot group's rows are split
    groups = cut(doubt.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), F.min(_order("id")).alias("first")), "groups")
    joined = doubt.join(groups, "text_sha256").select("id", F.col("first.id").alias("keep_id"), "group_size", (F.col("first.uid") == F.col("uid")).alias("kept"), "text_sha256")
    return alone.unionByName(joined).withColumnRenamed("id", id_col)


def _order(id_col: str) -> Column:
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("uid"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without exact copies; whole rows, and only those that may repeat shuffle.

    Which rows stay is decided from hashes and ids alone. Whole rows then meet the deciding
    (hash, id), not the hash, so that no group of copies gathers in one task.
    """
    at = docs.select(whole(docs).alias("row"), F.col(f"`{id_col}`").alias("id"), normalised_sha(F.col(f"`{text_col}`")).alias("sha"))
    # the filter and each group's first id come from the hashes alone, written once
    digest = cut(at.select("sha", "id"), "hashes")
    blocks = filter_blocks(digest.count())
    filt = cut(repeat_filter(digest, F.col("sha"), blocks), "filter")
    rows = maybe_in(digest, F.col("sha"), filt, blocks).where("__maybe").groupBy("sha", "id").agg(F.count(F.lit(1)).alias("rows"))
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("rows"))
    first = cut(rows.groupBy("sha").agg(F.min(order).alias("first")).select(F.col("sha").alias("g"), F.col("first.id").alias("first"), F.col("first.rows").alias("rows")), "first")
    tested = maybe_in(at, F.col("sha"), filt, blocks)
    doubt = tested.where("__maybe").drop("__maybe")
    # rows that tie on hash and id: one stays, and each task passes on one of its own
    ties = first.where("rows > 1")
    tie_blocks = filter_blocks(ties.count())
    key = F.xxhash64("sha", "id")
    doubt = maybe_in(doubt, key, membership_filter(ties.select(F.xxhash64("g", "first").alias("k")), F.col("k"), tie_blocks), tie_blocks)
    once = doubt.where("not __maybe").select("row", "sha", "id").union(doubt.where("__maybe").groupBy("sha", "id").agg(F.first("row").alias("row")).select("row", "sha", "id"))
    stay = once.join(first, (F.col("sha") == F.col("g")) & F.col("id").eqNullSafe(F.col("first")), "left_semi")
    return tested.where("not __maybe").select("row.*").union(stay.select("row.*"))
