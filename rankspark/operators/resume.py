"""Experience, education, skills and names of parsed lines, as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

RAW_CHARS, MOST_SKILLS, FEWEST_SKILLS = 600, 30, 3


def _without(text: Column, part: Column) -> Column:
    """``text`` without ``part``, whatever its case, trimmed of separators."""
    return F.regexp_replace(F.regexp_replace(text, F.concat(F.lit("(?iu)\\Q"), part, F.lit("\\E")), F.lit("")), X.EDGES, "")


def _anchored(lines: DataFrame, orgs: DataFrame, section: str, doc: str) -> DataFrame:
    at = lines.where((F.col("section") == section) & (X.strip(F.col("text")) != "")).withColumn("text", X.strip(F.col("text")))
    at = at.join(orgs.select(F.col(doc).alias("__d"), "orgs"), F.col(doc) == F.col("__d"), "left").drop("__d")
    at = at.withColumn("orgs", F.coalesce("orgs", F.array().cast("array<string>"))).withColumn("dates", X.first_dates(F.col("text")))
    at = at.withColumn("anchor", F.col("dates").isNotNull()).withColumn("bare", X.strip(X.without_bullet(F.col("text"))))
    at = at.withColumn("bullet", F.col("bare") != F.col("text")).withColumn("hit", X.org_in_line(F.col("text"), F.col("orgs")))
    upto = Window.partitionBy(doc).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return at.withColumn("block", F.sum(F.col("anchor").cast("int")).over(upto))


def experience(lines: DataFrame, orgs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, block, organization, role, start, end, raw): one row for each line with a date.

    ``lines`` have doc, line_no, section and text; ``orgs`` has doc and an array of
    organisations. A line's organisation is what is left without its dates, if it looks
    like one or is one; else the last organisation named before on a line of its own, else
    one that stands in the line.
    """
    at = _anchored(lines, orgs, "experience", doc)
    role0 = F.nullif(X.without_dates(F.col("text")), F.lit(""))
    at = at.withColumn("role0", F.when(F.col("anchor"), role0))
    by_shape = F.coalesce(X.looks_like_org(F.col("role0")), F.lit(False))
    by_name = F.coalesce(F.lower("role0") == F.lower("hit"), F.lit(False))
    sets = F.when(
        F.col("anchor"), F.when(by_shape, F.col("role0")).when(by_name, F.col("hit"))
    ).otherwise(F.when((F.col("block") == 0) & ~F.col("bullet") & (F.size(X.tokens(F.col("bare"))) <= 4), F.col("bare")))
    before = Window.partitionBy(doc).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("sets", sets).withColumn("pending", F.last("sets", ignorenulls=True).over(before))
    own = by_shape | by_name
    org = F.when(own, F.col("sets")).otherwise(F.coalesce("pending", "hit"))
    at = at.withColumn("org", F.when(F.col("anchor"), org))
    inside = F.coalesce(F.contains(F.lower("role0"), F.lower("org")), F.lit(False))
    role = F.when(own, F.lit(None)).when(inside, F.nullif(_without(F.col("role0"), F.col("org")), F.lit(""))).otherwise(F.col("role0"))
    at = at.withColumn("role", F.when(F.col("anchor") & ~X.is_residue(role), role))
    follows = ~F.col("anchor") & ~F.col("bullet") & F.size(X.tokens(F.col("bare"))).between(1, 6)
    return at.where("block > 0").groupBy(doc, "block").agg(
        F.max("org").alias("organization"),
        F.coalesce(F.max("role"), F.min_by("bare", F.when(follows, F.col("line_no")))).alias("role"),
        *_ends_and_raw(),
    )


def _ends_and_raw() -> list[Column]:
    raw = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda r: r["text"]), "\n")
    return [F.max("dates.start").alias("start"), F.max("dates.end").alias("end"), F.substring(raw, 1, RAW_CHARS).alias("raw")]


def education(lines: DataFrame, orgs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, block, institution, degree, start, end, raw). An organisation in the line wins
    over one named before the first date; a later line may name a missing one."""
    at = _anchored(lines, orgs, "education", doc)
    before = Window.partitionBy(doc).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    named = F.when((F.col("block") == 0) & ~F.col("bullet") & (F.size(X.tokens(F.col("bare"))) <= 6), F.col("bare"))
    at = at.withColumn("named", named).withColumn("pending", F.when(F.col("block") == 1, F.last("named", ignorenulls=True).over(before)))
    at = at.withColumn("inst", F.when(F.col("anchor"), F.coalesce("hit", "pending")))
    left = X.without_dates(F.col("text"))
    left = F.when(F.col("inst").isNotNull(), F.regexp_replace(left, F.concat(F.lit("(?iu)\\Q"), F.col("inst"), F.lit("\\E")), F.lit(""))).otherwise(left)
    degree = F.nullif(F.regexp_replace(X.strip(F.regexp_replace(left, r"(?U)\s+", " ")), X.EDGES, ""), F.lit(""))
    at = at.withColumn("degree", F.when(F.col("anchor"), degree))
    return at.where("block > 0").groupBy(doc, "block").agg(
        F.coalesce(F.max("inst"), F.min_by("hit", F.when(~F.col("anchor") & F.col("hit").isNotNull(), F.col("line_no")))).alias("institution"), F.max("degree").alias("degree"), *_ends_and_raw()
    )


def skills(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, pos, skill): items of the skills section, the first of each spelling, in order."""
    at = lines.where(F.col("section") == "skills").select(doc, "line_no", F.posexplode(X.split_items(X.skill_payload(F.col("text")))).alias("i", "skill"))
    at = at.where(~X.is_skill_noise(F.col("skill")))
    first = at.groupBy(doc, F.lower("skill").alias("key")).agg(F.min(F.struct("line_no", "i", "skill")).alias("at"))
    order = Window.partitionBy(doc).orderBy("at.line_no", "at.i")
    return first.select(doc, F.row_number().over(order).alias("pos"), F.col("at.skill").alias("skill"))


def names(lines: DataFrame, doc: str = "doc_id", persons: DataFrame | None = None) -> DataFrame:
    """(doc, name): the first valid person of a model's (doc, pos, person), else the first
    valid one of the first three lines; documents without one are missing."""
    w = Window.partitionBy(doc).orderBy("line_no")
    first = lines.select(doc, "line_no", "text").withColumn("n", F.row_number().over(w)).where("n <= 3")
    found = first.select(doc, F.lit(1).alias("by"), F.col("n").alias("pos"), X.valid_name(X.strip(F.regexp_extract("text", r"^[^\n]*", 0))).alias("name"))
    if persons is not None:
        found = found.unionByName(persons.select(doc, F.lit(0).alias("by"), "pos", X.valid_name(X.strip(F.regexp_extract("person", r"^[^\n]*", 0))).alias("name")))
    return found.where("name is not null").groupBy(doc).agg(F.min_by("name", F.struct("by", "pos")).alias("name"))
