"""Ingestion of a landing directory or any streaming source of attachments.

Rows pass screening, get their content hash, and reach the candidate table in foreachBatch:
duplicates in the batch and hashes the table knows go, the rest is parsed and appended. The
checkpoint and the table's keys make a replayed batch harmless. State doesn't grow: the
table is the memory of what was seen.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash, final_name, sanitize_filename
from ..operators import store
from ..sources.files import EXTENSIONS, suffix


def landing(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (path, content, ...) of the files that appear under a path; temporary
    files (_tmp_...) are left alone."""
    at = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", True).load(path)
    return at.where(~F.col("path").rlike("/_tmp_[^/]*$"))


def attachments(messages: DataFrame, extensions: tuple = EXTENSIONS) -> DataFrame:
    """One row for each attachment (uid, sender, subject, filename, content, content_hash,
    sanitized) of messages (uid, sender, subject, attachments: array<filename, payload>)."""
    at = messages.select("uid", "sender", "subject", F.explode("attachments").alias("a"))
    at = at.select("uid", "sender", "subject", F.col("a.filename").alias("filename"), F.col("a.payload").alias("content")).where(suffix(F.col("filename")).isin(*extensions))
    return at.withColumn("content_hash", content_hash(F.col("content"))).withColumn("sanitized", sanitize_filename(F.col("filename")))


def ingest_batch(batch: DataFrame, table: store.Table, parse: Callable[[DataFrame], DataFrame] | None = None, replace: bool = False, named: bool = False) -> dict:
    """Adds what is new in a batch (source_file, content, content_hash) to a table.

    Files are the same if their contents are; a name may occur with several contents. ``parse``
    turns new rows into candidate rows with a column ``error``; rows with an error are
    counted, and kept in quarantine() with their reason instead, and don't stop the others.
    replace: rows of the batch's names are parsed anew, and take the place of the old ones
    in the same write; a file that fails leaves its old row alone. named: source_file
    becomes {id}_{name}, as for mail, where names repeat.
    """
    current = table.read()
    new = distinct_contents(batch)
    if not replace:
        new = new.join(current.select("content_hash").where("content_hash is not null").distinct(), "content_hash", "left_anti")
    parsed = (parse(new) if parse else new.withColumn("error", F.lit(None).cast("string"))).cache()
    try:
        total = parsed.agg(F.count(F.lit(1)).alias("pulled"), F.count_if(F.col("error").isNull()).alias("parsed"), F.count_if(F.col("error").isNotNull()).alias("errors")).first().asDict()
        if total["errors"]:
            parsed.where("error is not null").select("source_file", "content_hash", "error", F.current_timestamp().alias("at")).write.mode("append").parquet(quarantine_path(table))
        if total["parsed"]:
            rows = store.with_ids(parsed.where("error is null").drop("error"), current, "source_file")
            if named:
                rows = rows.withColumn("source_file", final_name(F.col("id"), sanitize_filename(F.col("source_file"))))
            if replace:
                store.replace(table, current, rows, "source_file")
            else:
                table.append(rows)
        return total
    finally:
        parsed.unpersist()


def distinct_contents(batch: DataFrame) -> DataFrame:
    """One row of each content_hash, the one with the least source_file. Names and hashes decide; only
    contents that stand several times under that name are grouped whole."""
    named = batch.where("content_hash is not null").groupBy("content_hash", "source_file").agg(F.count(F.lit(1)).alias("n"))
    first = named.groupBy("content_hash").agg(F.min(F.struct("source_file", "n")).alias("least")).select(F.col("content_hash").alias("__hash"), "least.source_file", F.col("least.n").alias("__n"))
    first = first.withColumnRenamed("source_file", "__name")
    kept = batch.join(first, (F.col("content_hash") == F.col("__hash")) & F.col("source_file").eqNullSafe(F.col("__name"))).drop("__hash", "__name")
    return kept.where("__n = 1").drop("__n").unionByName(kept.where("__n > 1").drop("__n").dropDuplicates(["content_hash"]))


def quarantine_path(table: store.Table) -> str:
    return f"{table.path}-quarantine"


def quarantine(table: store.Table) -> DataFrame:
    """Files that failed (source_file, content_hash, error, at)."""
    schema = "source_file string, content_hash string, error string, at timestamp"
    fs, _ = table._fs()
    there = fs.exists(table.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(quarantine_path(table)))
    return table.spark.read.schema(schema).parquet(quarantine_path(table)) if there else table.spark.createDataFrame([], schema)


def start(stream: DataFrame, table: store.Table, checkpoint: str, parse=None, every: str | None = None, on_batch=None, named: bool = False, name: str | None = None):
    """A running query: each trigger (``every``, such as "300 seconds"), or all that is there
    once. ``on_batch`` gets each batch's summary. name: the query's."""

    def run(batch: DataFrame, _: int) -> None:
        done = ingest_batch(batch, table, parse, named=named)
        if on_batch:
            on_batch(done)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.queryName(name) if name else writer
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def run_with_retries(make: Callable, retries: int = 2, wait_s: float = 60.0):
    """Runs a query to its end; after a failure it starts again from its checkpoint."""
    for k in range(retries + 1):
        query = make()
        try:
            query.awaitTermination()
            return query
        except Exception:
            if k == retries:
                raise
            time.sleep(wait_s)


def status(query) -> dict:
    """State, last progress and error of a running or ended query."""
    return {"id": str(query.runId), "active": query.isActive, "status": query.status, "progress": query.lastProgress, "error": str(query.exception()) if query.exception() else None}


# --- extras on event streams ---------------------------------------------------------------


def event_windows(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums for each tumbling window and type; late events within the watermark count."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return at.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
