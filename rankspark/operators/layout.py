"""Lines from the words of PDF pages: columns by a histogram, lines by height."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS, FEWEST_WORDS, PEAK, APART, TOLERANCE = 50, 30, 2.0, 0.20, 3.0


def gutters(words: DataFrame) -> DataFrame:
    """(doc_id, page, gutter): the x between two columns, for pages that have two.

    Word centres are counted in 50 bins over the page, smoothed by three; peaks reach twice
    the median and both neighbours. The gutter is the lowest bin from the first peak to the
    last, if they are a fifth of the width apart.
    """
    page = ["doc_id", "page"]
    centre = (F.col("x0") + F.col("x1")) / 2
    at = words.withColumn("bin", F.when(centre == F.col("page_width"), BINS - 1).otherwise(F.floor(centre / F.col("page_width") * BINS)))
    n = at.groupBy(*page).agg(F.count(F.lit(1)).alias("n"), F.max("page_width").alias("width")).where(F.col("n") >= FEWEST_WORDS)
    counts = at.groupBy(*page, "bin").agg(F.count(F.lit(1)).alias("c"))
    dense = n.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1)).cast("array<bigint>"))).join(counts, [*page, "bin"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    w = Window.partitionBy(*page).orderBy("bin")
    s = dense.withColumn("s", (F.coalesce(F.lag("c").over(w), F.lit(0)) + F.col("c") + F.coalesce(F.lead("c").over(w), F.lit(0))) / 3.0)
    median = s.groupBy(*page).agg(F.median("s").alias("m")).where("m > 0")
    s = s.join(median, page).withColumn("peak", F.col("bin").between(1, BINS - 2) & (F.col("s") >= PEAK * F.col("m")) & (F.col("s") >= F.lag("s").over(w)) & (F.col("s") >= F.lead("s").over(w)))
    ends = s.where("peak").groupBy(*page).agg(F.min("bin").alias("p1"), F.max("bin").alias("p2")).where((F.col("p2") > F.col("p1")) & ((F.col("p2") - F.col("p1")) / BINS >= APART))
    return s.join(ends, page).where("bin between p1 and p2").groupBy(*page).agg(F.min(F.struct("s", "bin", (F.col("bin") / BINS * F.col("width")).alias("x"))).alias("low")).select(*page, F.col("low.x").alias("gutter"))


def lines(words: DataFrame) -> DataFrame:
    """Lines in reading order: the left column of a page, then the right one. A line's words
    are within three points of its first word's top; a page's words are one bounded group."""
    page = ["doc_id", "page"]
    at = words.join(gutters(words), page, "left").withColumn("col", F.when((F.col("x0") + F.col("x1")) / 2 >= F.col("gutter"), 1).otherwise(0))
    sorted_words = F.sort_array(F.collect_list(F.struct("top", "x0", "seq", "text", F.coalesce("size", F.lit(10.0)).alias("size"), F.coalesce(F.lower("fontname").contains("bold"), F.lit(False)).alias("bold"))))
    groups = at.groupBy(*page, "col").agg(sorted_words.alias("ws"))
    start = F.struct(F.lit(-1).alias("line"), F.lit(None).cast("double").alias("top"), F.array().cast("array<int>").alias("of"))

    def step(acc, x):
        new = acc["top"].isNull() | (F.abs(x["top"] - acc["top"]) > TOLERANCE)
        line = acc["line"] + new.cast("int")
        return F.struct(line.alias("line"), F.when(new, x["top"]).otherwise(acc["top"]).alias("top"), F.concat(acc["of"], F.array(line)).alias("of"))

    placed = groups.withColumn("of", F.aggregate("ws", start, step)["of"]).select(*page, "col", F.explode(F.arrays_zip("ws", "of")).alias("w")).select(*page, "col", F.col("w.of").alias("line"), "w.ws.*")
    return assemble(placed, [*page, "col", "line"])


def assemble(words: DataFrame, by: list[str]) -> DataFrame:
    """Text, largest size and boldness of each line; words from left to right."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "seq", "text"))), lambda w: w["text"]), " ")
    out = words.groupBy(*by).agg(F.trim(text).alias("text"), F.max("size").alias("max_font_size"), F.bool_or("bold").alias("is_bold"), F.min("top").alias("top")).where("text != ''")
    order = Window.partitionBy("doc_id").orderBy(*[c for c in by if c != "doc_id"])
    return out.withColumn("line_no", F.row_number().over(order)).select("doc_id", "line_no", "text", "max_font_size", "is_bold", "top", "col", "page")
