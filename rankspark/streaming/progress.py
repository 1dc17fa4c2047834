"""Progress of streaming runs in a table, which outlives the query, its session and its driver."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "run_id string, name string, kind string, at timestamp, batch_id bigint, rows bigint, error string, progress string"


class ProgressLog(StreamingQueryListener):
    """Appends a row to the table at ``path`` when a query of the given name starts, makes progress or
    ends, with its error if it failed. Queries of other names are left alone."""

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.path, self.name, self.runs = spark, path, name, set()

    def _add(self, run_id, kind: str, at=None, batch_id=None, rows=None, error=None, progress=None) -> None:
        row = self.spark.createDataFrame([(str(run_id), self.name, kind, at, batch_id, rows, error, progress)], "run_id string, name string, kind string, at string, batch_id bigint, rows bigint, error string, progress string")
        row = row.withColumn("at", F.coalesce(F.to_timestamp("at"), F.current_timestamp()))
        row.coalesce(1).write.mode("append").parquet(self.path)

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.runs.add(str(event.runId))
            self._add(event.runId, "started", event.timestamp)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name == self.name:
            self._add(p.runId, "progress", p.timestamp, p.batchId, p.numInputRows, None, p.json)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) in self.runs:
            self.runs.discard(str(event.runId))
            self._add(event.runId, "failed" if event.exception else "ended", error=event.exception)


def history(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the table; none if nothing has run."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], SCHEMA)


def last_run(spark: SparkSession, path: str) -> dict | None:
    """What the table says of the run that began last: its id, whether it is still going, batches, rows
    read (once for each reading of a batch) and error."""
    at = history(spark, path)
    own = at.groupBy("run_id").agg(
        F.min("at").alias("began"), F.max("at").alias("seen"), F.count_if(F.col("kind").isin("ended", "failed")).alias("over"), F.count_distinct("batch_id").alias("batches"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.max("error").alias("error"), F.max_by("progress", F.when(F.col("kind") == "progress", F.col("at"))).alias("progress"),
    ).orderBy(F.desc("began")).first()
    if own is None:
        return None
    return {"id": own["run_id"], "active": not own["over"], "began": own["began"], "seen": own["seen"], "batches": own["batches"], "rows": own["rows"], "error": own["error"], "progress": own["progress"]}
