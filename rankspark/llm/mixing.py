"""Mixing sources to target weights.

Words are summed for each source, targets and repetition rates are derived, and each
document is emitted floor(rate) times, plus one more copy with a probability equal to the
fraction, drawn from a hash of its id.

Defined results: a null text has no words; a null source is a source of its own, after
all others. Sources without words get target and rate 0. Documents with one id share one
draw, so reruns and any partitioning agree. An empty table gives an empty table. Other
columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, whole, word_count

#: Up to so many sources are broadcast (at most some MB); more are joined by a shuffle.
BROADCAST_SOURCES = 50_000


def source_plan(docs: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, cap: float = 2.0, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each source: source, source_size, target.

    Targets share ``share`` of all words by weight. A target stops at ``cap`` times its
    source's words, and the excess goes to the others by weight. In the order of
    words by weight, the sources that stop come first: source i stops if its cap is
    under the level that the rest of the budget gives the sources from i on.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(word_count(F.col(text_col))).cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    at = sizes.withColumn("__rank", rank).withColumn("__w", weight).withColumn("__cap", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("__cap") / F.col("__w"), "__rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    at = (
        at.withColumn("__budget", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("__level", (F.col("__budget") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__w").over(onward))
        .withColumn("__place", F.row_number().over(order))
        .withColumn("__goes_on", F.col("__cap") > F.col("__level") * F.col("__w"))
        # the first source that doesn't stop sets the level for itself and all after it
        .withColumn("__first", F.min(F.when(F.col("__goes_on"), F.struct("__place", "__level"))).over(whole))
    )
    stops = F.col("__first").isNull() | (F.col("__place") < F.col("__first.__place"))
    return at.withColumn("target", F.when(stops, F.col("__cap")).otherwise(F.col("__first.__level") * F.col("__w"))).select("source", "source_size", "target")


def draw(id_: Column, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of an MD5 of seed and id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **plan) -> DataFrame:
    """``docs`` with __size, __source_size, __target and __copies, which take the place of columns
    of these names."""
    docs = docs.drop("__size", "__source_size", "__target", "__copies")
    at = _rated(docs, id_col, text_col, source_col, seed, **plan)
    return at.select("row.*", F.col("size").alias("__size"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("copies").alias("__copies"))


def _rated(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, **plan) -> DataFrame:
    """row (all columns of ``docs``), size, source_size, target, copies."""
    sources = cut(source_plan(docs, text_col=text_col, source_col=source_col, **plan), "sources")
    side = sources.select(F.col("source").alias("of"), "source_size", "target")
    if sources.count() <= BROADCAST_SOURCES:
        side = F.broadcast(side)
    own = docs.select(whole(docs).alias("row"), F.col(f"`{source_col}`").alias("source"), draw(F.col(f"`{id_col}`"), seed).alias("draw"), word_count(F.col(f"`{text_col}`")).alias("size"))
    at = own.join(side, F.col("source").eqNullSafe(F.col("of")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = (F.col("draw") < rate - F.floor(rate)).cast("int")
    return at.select("row", "size", "source_size", "target", (F.floor(rate) + extra).cast("int").alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **plan) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, in the columns of ``docs``."""
    at = _rated(docs, id_col, text_col, source_col, seed, **plan).where("copies > 0")
    return at.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
