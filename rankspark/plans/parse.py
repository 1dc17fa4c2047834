"""Parsed records of documents: lines, sections, contacts, experience, education, skills."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as X
from ..operators import entities, keyphrases, resume, scratch, segment


#: Lines in which a model looks for the person's name.
HEAD_LINES = 5


def parse(lines: DataFrame, phrases: list[str] = (), model=None, person_model=None, fallback: bool = True) -> DataFrame:
    """(doc_id, raw_text, parsed) of the documents that ``lines`` has. Under three skills in
    the skills section, key phrases of the text stand in. ``model`` finds entities (one, or a tuple);
    person_model, or else it, also finds persons in the first lines.

    Lines are dealt to documents once and written with their sections; all that follows reads that
    table by document and exchanges nothing. Organisations are looked for only where a document has
    a section that needs them.
    """
    placed = scratch.by_key(segment.placed(lines).select("doc_id", "line_no", "text", "section", "header"), "lines", "doc_id", "line_no")
    own = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    dated = F.bool_or(F.col("header").isNull() & F.col("section").isin("experience", "education"))
    texts = placed.groupBy("doc_id").agg(own.alias("own"), dated.alias("dated")).select("doc_id", "dated", F.array_join("own", "\n").alias("raw_text"), F.array_join(F.slice("own", 1, HEAD_LINES), "\n").alias("head"))
    orgs = entities.extract(texts.where("dated"), list(phrases), "raw_text", model).select("doc_id", entities.organisations(F.col("entities")).alias("orgs"))
    orgs = scratch.by_key(orgs, "organisations", "doc_id")
    persons = None
    if person_model or model:
        persons = texts.select("doc_id", F.posexplode(entities.persons(F.col("head"), person_model or model)).alias("pos", "person"))
    names = resume.names(placed, persons=persons)
    placed = placed.where("header is null")
    jobs, schools = (_entries(f(placed, orgs), kind) for f, kind in ((resume.experience, schemas.EXPERIENCE), (resume.education, schemas.EDUCATION)))
    skills = resume.skills(placed).groupBy("doc_id").agg(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("pos", "skill"))), 1, resume.MOST_SKILLS), lambda s: s["skill"]).alias("skills"))
    skills = skills.where(F.size("skills") >= resume.FEWEST_SKILLS)
    at = texts.select("doc_id", "raw_text").join(names, "doc_id", "left").join(jobs.withColumnRenamed("entries", "experience"), "doc_id", "left").join(schools.withColumnRenamed("entries", "education"), "doc_id", "left").join(skills, "doc_id", "left")
    if fallback:
        at = keyphrases.keyphrases(at.withColumn("lacking", F.when(F.col("skills").isNull(), F.col("raw_text"))), "lacking", "name").withColumn("skills", F.coalesce("skills", "phrases"))
    text = F.col("raw_text")
    none = lambda c, t: F.coalesce(F.col(c), F.array().cast(t))
    parsed = F.struct(
        F.col("name"), X.email(text).alias("email"), X.phone(text).alias("phone"), X.languages(text).alias("languages_detected"), none("skills", "array<string>").alias("skills"),
        F.coalesce("experience", F.array().cast(schemas.PARSED["experience"].dataType)).alias("experience"), F.coalesce("education", F.array().cast(schemas.PARSED["education"].dataType)).alias("education"), F.lit(None).cast("string").alias("category"),
    )
    return at.select("doc_id", "raw_text", parsed.alias("parsed"))


def _entries(rows: DataFrame, kind) -> DataFrame:
    fields = [f.name for f in kind]
    at = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("block", *fields))).alias("found"))
    return at.select("doc_id", F.transform("found", lambda e: F.struct(*[e[f].alias(f) for f in fields])).alias("entries"))
