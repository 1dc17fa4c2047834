"""Keyed writes on Parquet: a table is a row of versions.

A version is a folder next to the older ones, so a reader never sees half a table and a path
is never overwritten while it is read. ``write`` makes a whole table (v-...); ``append`` writes
the new rows alone (a-...), to be read with the versions before it back to the last whole one;
``change`` writes those partitions whose rows change (c-...), in place of the older ones of their name.
Versions are partitioned by a hash of the key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash, strip
from .scratch import folder

#: Appended and changed versions until a table is made whole again.
MOST_PARTS = 100
#: Partitions of a table.
BUCKETS = 64


def new_rows(incoming: DataFrame, existing: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``incoming`` whose key isn't there yet; of equal keys in it, one."""
    return incoming.dropDuplicates(list(keys)).join(existing.select(*keys).distinct(), list(keys), "left_anti")


def known_rows(incoming: DataFrame, existing: DataFrame, *keys: str) -> DataFrame:
    return incoming.join(existing.select(*keys).distinct(), list(keys), "left_semi")


def upsert(existing: DataFrame, incoming: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Insert-if-absent; with ``force``, rows of ``incoming`` replace those of their key."""
    if not force:
        return existing.unionByName(new_rows(incoming, existing, key), allowMissingColumns=True)
    return existing.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming.dropDuplicates([key]), allowMissingColumns=True)


def delete(existing: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return existing.join(keys.select(key).distinct(), key, "left_anti")


def with_ids(rows: DataFrame, existing: DataFrame, order: str, id_col: str = "id") -> DataFrame:
    """Consecutive ids after the greatest one there; for a single writer.

    The rows are dealt by ranges of ``order`` and written once, so that their places are
    fixed; each range's ids start after the rows of the ranges before it.
    """
    spark = rows.sparkSession
    path = folder(spark, "numbered")
    own = rows.drop(id_col).withColumn("__order", F.col(order))
    own.repartitionByRange("__order").sortWithinPartitions("__order").drop("__order").withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
    at = spark.read.parquet(path).withColumn("__part", F.shiftright("__at", 33))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = at.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__low"))
    # one row for each range
    starts = parts.select("__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__low") + 1).alias("__shift"))
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("__top"))
    placed = at.join(F.broadcast(starts.crossJoin(F.broadcast(top))), "__part")
    return placed.withColumn(id_col, (F.col("__at") + F.col("__shift") + F.col("__top")).cast("long")).drop("__at", "__part", "__shift", "__top")


def update_candidates(existing: DataFrame, changes: DataFrame, *columns: str, key: str = "id") -> DataFrame:
    """Null keeps the old value; a blank one clears it."""
    new = changes.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    at = existing.join(new, key, "left")
    return at.select(*[F.when(F.col(f"__{c}").isNull(), F.col(c)).otherwise(F.nullif(strip(F.col(f"__{c}")), F.lit(""))).alias(c) if c in columns else F.col(c) for c in existing.columns])


def update_vacancies(existing: DataFrame, changes: DataFrame, embed: Column, key: str = "id") -> DataFrame:
    """Title, description and experience change where given; the embedding is computed anew
    only where title or description are really other ones. ``embed`` is an expression over
    the columns title and description."""
    names = ("title", "description", "experience")
    at = existing.join(changes.select(key, *[F.col(c).alias(f"__{c}") for c in names]), key, "left")
    changed = F.coalesce(F.col("__title") != F.col("title"), F.lit(False)) | F.coalesce(F.col("__description") != F.col("description"), F.lit(False))
    at = at.withColumn("__changed", changed)
    for c in names:
        at = at.withColumn(c, F.coalesce(f"__{c}", c))
    # only changed rows reach the embedder
    same = at.where("not __changed").select(*existing.columns)
    return same.unionByName(at.where("__changed").withColumn("embedding", embed).select(*existing.columns))


def backfill_embeddings(existing: DataFrame, embed: Column) -> DataFrame:
    """Embeddings where there is none; other rows don't reach the embedder."""
    return existing.where("embedding is not null").unionByName(existing.where("embedding is null").withColumn("embedding", embed).select(*existing.columns))


def backfill_hashes(existing: DataFrame, files: DataFrame) -> DataFrame:
    """content_hash of the file at source_file where it is null; missing files stay null."""
    at = files.select(F.col("path").alias("source_file"), content_hash(F.col("content")).alias("__h")).dropDuplicates(["source_file"])
    return existing.join(at, "source_file", "left").withColumn("content_hash", F.coalesce("content_hash", "__h")).select(*existing.columns)


class Table:
    """A table of numbered versions under one path, for one writer at a time. The current
    version is the last one whose write was committed.

    buckets: partitions by a hash of the key, a null key's too. A table that was written with another number, or
    before there were any, is read as well; its first change writes it whole.
    """

    def __init__(self, spark: SparkSession, path: str, schema, key: str = "id", buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.buckets = spark, path.rstrip("/"), schema, buckets
        # a table without the column is keyed by its first one
        self.key = key if key in schema.names else schema.names[0]
        self._column = f"bucket_of_{buckets}"

    def _fs(self, name: str = ""):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _names(self, name: str = "") -> list[str]:
        fs, at = self._fs(name)
        return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []

    def _versions(self) -> dict[int, str]:
        """Committed versions and their folders."""
        return {int(n[2:]): n for n in self._names() if n[:2] in ("v-", "a-", "c-") and "_SUCCESS" in self._names(n)}

    def version(self) -> int | None:
        return max(self._versions(), default=None)

    def _parts(self, now: int | None) -> list[str]:
        """Folders that make up a version, oldest first."""
        held = {k: n for k, n in self._versions().items() if now is not None and k <= now}
        whole = max((k for k, n in held.items() if n.startswith("v-")), default=0)
        return [n for k, n in sorted(held.items()) if k >= whole]

    def _partitions(self, now: int | None) -> dict[str, list[str]]:
        """Each partition's folders in a version."""
        out = {}
        for part in self._parts(now):
            for name in self._names(part):
                if name[0] not in "_.":
                    out[name] = [*(out.get(name, []) if part[0] != "c" else []), f"{part}/{name}"]
        return out

    def _scan(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        # the partitions' column isn't read: it can't clash, and folders of several versions go together
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(*[f"{self.path}/{n}" for n in folders])

    def read(self, version: int | None = None) -> DataFrame:
        now = self.version() if version is None else version
        parts = self._parts(now)
        if any(n.startswith("c-") for n in parts):
            parts = [f for folders in self._partitions(now).values() for f in folders]
        return self._scan(parts)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(f"`{self.key}`").cast(self.schema[self.key].dataType)), F.lit(self.buckets)).cast("int")

    def _save(self, df: DataFrame, kind: str, touched: tuple = ()) -> int:
        columns = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        now = self.version()
        new = 0 if now is None else now + 1
        folder = f"{kind}-{new:09d}"
        fs, at = self._fs(folder)
        fs.delete(at, True)  # what a failed write left
        for name in touched:  # those that lose all their rows are there too, empty
            fs.mkdirs(self._fs(f"{folder}/{name}")[1])
        # one task writes a small partition, several a large one
        rows = df.select(*columns).withColumn(self._column, self._bucket()).hint("rebalance", self._column)
        rows.write.mode("append").partitionBy(self._column).parquet(f"{self.path}/{folder}")
        return new

    def write(self, df: DataFrame) -> int:
        """A version of these rows alone."""
        return self._save(df, "v")

    def append(self, df: DataFrame) -> int:
        """A version of the rows there are and these. Old rows aren't written again, but for
        one append or change in MOST_PARTS, which makes the table whole so that readers list few folders."""
        now = self.version()
        if len(self._parts(now)) < MOST_PARTS:
            return self._save(df, "a")
        return self.write(self.read(now).unionByName(df, allowMissingColumns=True))

    def change(self, keys: DataFrame, make: Callable[[DataFrame], DataFrame]) -> int | None:
        """A version where ``make`` has turned the rows of the partitions of ``keys`` (a column named as the table's
        key) into other ones, whose keys are in those partitions too: rows that it adds or takes
        away, or changes, have their keys in ``keys``. Other partitions' files stay as they are. No key, no new version."""
        now = self.version()
        parts = self._parts(now)
        # at most ``buckets`` rows
        touched = tuple(sorted(f"{self._column}={r[0]}" for r in keys.select(self._bucket()).distinct().collect()))
        if not touched:
            return now
        held = self._partitions(now)
        if len(parts) >= MOST_PARTS or any(not n.startswith(f"{self._column}=") for n in held):
            return self.write(make(self.read(now)))
        return self._save(make(self._scan([f for n in touched for f in held.get(n, [])])), "c", touched)


def replace(table: Table, current: DataFrame, rows: DataFrame, by: str) -> int | None:
    """A version of ``table`` where ``rows``, with keys of their own, take the place of the rows of ``current``
    with the same ``by``."""
    gone = known_rows(current, rows, by).select(table.key)
    return table.change(gone.unionByName(rows.select(table.key)), lambda at: delete(at, rows, by).unionByName(rows, allowMissingColumns=True))
