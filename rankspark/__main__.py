"""Command line: rank, parse, import, embed, labelled, ingest, mail, evaluate."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .functions.text import match_line
from .operators.scoring import Prompts
from .plans.engine import Engine
from .sources import files, mailbox


def provider(name: str | None):
    """The function that module:function names."""
    module, _, function = (name or "").partition(":")
    return getattr(importlib.import_module(module), function) if name else None


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="rankspark")
    p.add_argument("--root", required=True, help="folder of the engine's tables")
    p.add_argument("--settings", help="YAML file")
    p.add_argument("--gazetteer", help="file of organisations' names, one a line")
    p.add_argument("--pdf-words", help="module:function from a PDF's bytes to its words (sources.files.extract_lines)")
    p.add_argument("--scorer", help="module:function from (system, prompt) to a scorer's answer, plain or async")
    p.add_argument("--prompts", help="YAML file of system_en, system_ru and user")
    sub = p.add_subparsers(dest="command", required=True)
    rank = sub.add_parser("rank")
    rank.add_argument("--job-id", type=int)
    rank.add_argument("--text")
    rank.add_argument("--title")
    rank.add_argument("--strategy")
    rank.add_argument("--top-k", type=int)
    parse = sub.add_parser("parse")
    parse.add_argument("path")
    parse.add_argument("--force", action="store_true")
    parse.add_argument("--dry-run", action="store_true")
    load = sub.add_parser("import")
    load.add_argument("path")
    load.add_argument("--force", action="store_true")
    sub.add_parser("embed")
    labelled = sub.add_parser("labelled")
    labelled.add_argument("path")
    ingest = sub.add_parser("ingest", help="files that have landed in a folder")
    ingest.add_argument("path")
    ingest.add_argument("--poll", action="store_true", help="go on looking for files every poll_seconds")
    sub.add_parser("status", help="the last run's progress")
    mail = sub.add_parser("mail", help=".eml files in a folder, or an IMAP mailbox")
    mail.add_argument("path", nargs="?")
    mail.add_argument("--imap", action="append", default=[], metavar="OPTION=VALUE")
    test = sub.add_parser("evaluate")
    test.add_argument("--ranker", default="rrf")
    test.add_argument("--retriever", default="semantic")
    test.add_argument("--subset", type=int)
    test.add_argument("--no-boost", action="store_true", help="without the category boost")
    test.add_argument("--compare-boost", action="store_true", help="TF-IDF without and with the boost")
    test.add_argument("--qualitative", action="store_true", help="also the first five of each query")
    a = p.parse_args(argv)
    if a.command == "mail" and bool(a.path) == bool(a.imap):
        p.error("give a folder of .eml files, or --imap options")
    spark = SparkSession.builder.appName("rankspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    phrases = tuple(r["phrase"] for r in files.gazetteer(spark, a.gazetteer).collect()) if a.gazetteer else ()  # some hundred lines
    engine = Engine(spark, a.root, Settings.load(a.settings) if a.settings else None, scorer=provider(a.scorer), pdf_words=provider(a.pdf_words), phrases=phrases, prompts=Prompts.load(a.prompts) if a.prompts else None)
    if a.command == "rank":
        if a.job_id is None and a.text is None:  # all vacancies, in one job
            queries = engine.vacancies.read().where("embedding is not null").select(F.col("id").alias("query_id"), F.concat("title", F.lit("\n\n"), "description").alias("query_text"), "embedding")
            payload = engine.candidates.read().select(F.col("id").alias("candidate_id"), "name", "email", "source_file")
            found = engine.rank(queries, a.strategy or "rrf", a.top_k or 5).join(payload, "candidate_id", "left").orderBy("query_id", "rank")
        else:
            found = engine.recommend(a.job_id, a.text, a.title, a.strategy, a.top_k)
        for r in found.select("query_id", match_line(F.col("rank"), F.col("score"), F.col("name"), F.col("email"), F.col("source_file")).alias("line")).toLocalIterator():
            print(r["query_id"], r["line"])
    elif a.command == "parse":
        got = engine.parse_path(a.path, a.force, a.dry_run)
        print(got) if isinstance(got, dict) else got.show(truncate=80)
    elif a.command == "import":
        print(engine.import_vacancies(a.path, a.force))
    elif a.command == "embed":
        engine.embed_vacancies()
    elif a.command == "labelled":
        engine.import_labelled(a.path)
    elif a.command == "ingest":
        engine.ingest_to_the_end(a.path, a.poll)
    elif a.command == "status":
        print(engine.status())
    elif a.command == "mail":
        if a.imap:
            spark.dataSource.register(mailbox.Mailbox)
            messages = spark.readStream.format("imap").options(**dict(o.split("=", 1) for o in a.imap)).load()
        else:
            messages = mailbox.eml_stream(spark, a.path)
        engine.ingest_mail(messages)
        engine.wait()
    else:
        if a.compare_boost:
            engine.compare_boost(subset=a.subset).show(truncate=False)
            return
        got = engine.evaluation(a.ranker, retriever=a.retriever, subset=a.subset, boost=0.0 if a.no_boost else None)
        got.per_query.orderBy(F.desc("p_at_5")).show(100)
        got.averages.show()
        if a.qualitative:
            for r in got.examples.toLocalIterator():
                print(f"{r['category']} {r['title']}: {r['rank']}. [{'+' if r['hit'] else '-'}] {r['score']:.2f} {r['found_category']} {r['explanation'] or ''}")


if __name__ == "__main__":
    main()
