"""Shared pieces of the training-data operators: written tables, Bloom filters, scans.

Tables that cut lineage go to the folder the cluster names in ``spark.checkpoint.dir``
(shared by driver and executors), never to a machine-local folder.
"""

from __future__ import annotations

import atexit
import math
import re
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space bytes.
WORD = "[^\\x20\\x09-\\x0D]+"
SPACE = "[\\x20\\x09-\\x0D]+"

#: A filter block is one 4 KB bitmap: the layout of Spark's bitmap_construct_agg.
BLOCK_BITS = 32_768
#: Upper bound of any filter that is broadcast: 2**28 bits are 32 MB.
MAX_FILTER_BITS = 1 << 28
PROBES = 4


def shared_dir(spark: SparkSession) -> str:
    """The shared folder from the session; a temporary one only where none is set (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    found = found or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="rankspark-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder, in a folder for each value of the
    columns ``by``, and return a scan of it.

    The table survives lost executors, and its rows stay the same however often they
    are read. It is deleted when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rankspark/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


#: Rows of a narrow table that is broadcast.
BROADCAST_ROWS = 500_000


def broadcast_if_small(table: DataFrame) -> DataFrame:
    """A written table of a few narrow columns, broadcast if it has up to BROADCAST_ROWS rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def release(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t.written_at)


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # the session ended before the process
        return
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        # the session's settings, which hold the file system's credentials
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    except Py4JError as why:
        print(f"rankspark: {path} was not deleted: {why}", file=sys.stderr)


def spare(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores in front as make it differ from all columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def whole(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct: beside it, an operator's own names can't clash."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Texts are long: the Arrow batches that reach Python workers are bounded in bytes.

    Sets the session's spark.sql.execution.arrow.maxBytesPerBatch where it has its default of
    64 MB; rows and results don't depend on it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "67108864", "64MB"):
        spark.conf.set(key, str(BATCH_BYTES))


def worker_cache(key: str, make):
    """One object for each Python worker, kept between tasks."""
    store = sys.__dict__.setdefault("_rankspark_cache", {})
    if key not in store:
        store[key] = make()
    return store[key]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# --- Blocked Bloom filters -------------------------------------------------------------


def filter_blocks(rows: int, bits_per_row: int = 32) -> int:
    """Number of 4 KB blocks for so many rows, never more than MAX_FILTER_BITS in all.

    Beyond the bound more rows test positive; they take the shuffled way, and results
    stay the same.
    """
    bits = 1 << max(15, math.ceil(math.log2(max(1, rows * bits_per_row))))
    return min(bits, MAX_FILTER_BITS) // BLOCK_BITS


def with_probes(df: DataFrame, key: Column, blocks: int) -> DataFrame:
    """Adds __block (the key's block) and __mix (64 bits that hold its bit positions)."""
    return df.withColumn("__mix", F.xxhash64(key)).withColumn(
        "__block", F.pmod(F.col("__mix"), F.lit(blocks)).cast("int")
    ).withColumn("__mix", F.xxhash64(F.col("__mix"), F.lit(1)))


def _bit(i: int) -> Column:
    return F.shiftrightunsigned(F.col("__mix"), 15 * i).bitwiseAND(F.lit(BLOCK_BITS - 1))


def membership_filter(keys: DataFrame, key: Column, blocks: int) -> DataFrame:
    """Bloom filter (__fblock, __bits) of a table's keys, built by JVM aggregates."""
    at = with_probes(keys.select(key.alias("__key")), F.col("__key"), blocks)
    at = at.select("__block", F.explode(F.array(*[_bit(i) for i in range(PROBES)])).alias("__at"))
    return at.groupBy(F.col("__block").alias("__fblock")).agg(F.bitmap_construct_agg("__at").alias("__bits"))


def maybe_in(df: DataFrame, key: Column, filt: DataFrame, blocks: int, name: str = "__maybe") -> DataFrame:
    """Adds a boolean: false only if the filter surely lacks the key. The filter is
    broadcast; filter_blocks() bounds it."""
    at = with_probes(df, key, blocks).join(F.broadcast(filt), F.col("__block") == F.col("__fblock"), "left")
    test = F.lit(True)
    for i in range(PROBES):
        byte = F.expr(
            f"cast(conv(hex(substring(__bits, cast((shiftrightunsigned(__mix, {15 * i}) & 32767) div 8 as int) + 1, 1)), 16, 10) as int)"
        )
        test = test & (
            byte.bitwiseAND(F.expr(f"shiftleft(1, cast(shiftrightunsigned(__mix, {15 * i}) & 7 as int))")) != 0
        )
    return df_drop(at.withColumn(name, F.coalesce(test, F.lit(False))))


def df_drop(df: DataFrame) -> DataFrame:
    return df.drop("__mix", "__block", "__fblock", "__bits")


def repeat_filter(df: DataFrame, key: Column, blocks: int) -> DataFrame:
    """Bloom filter (__fblock, __bits) of the keys that may occur more than once.

    Each task marks two bitmaps, ``seen`` and ``again``; only those bitmaps shuffle.
    Where two tasks' ``seen`` overlap, the common bits join ``again``. A key with two
    rows always has all its bits in ``again``.
    """
    at = with_probes(df.select(key.alias("__key")), F.col("__key"), blocks).select("__block", "__mix")

    def mark(batches):
        seen = np.zeros(blocks * BLOCK_BITS // 8, np.uint8)
        again = np.zeros_like(seen)
        used = np.zeros(blocks, bool)
        for batch in batches:
            block = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            mix = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(mix):
                continue
            bits = [block * BLOCK_BITS + ((mix >> np.uint64(15 * i)) & np.uint64(BLOCK_BITS - 1)).astype(np.int64) for i in range(PROBES)]
            known = np.ones(len(mix), bool)
            for b in bits:
                known &= (seen[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1
            _, first, n = np.unique(mix, return_index=True, return_counts=True)
            known[first[n > 1]] = True
            for b in bits:
                np.bitwise_or.at(again, b[known] >> 3, (1 << (b[known] & 7)).astype(np.uint8))
                np.bitwise_or.at(seen, b >> 3, (1 << (b & 7)).astype(np.uint8))
            used[block] = True
        ids = np.flatnonzero(used)
        s, a = seen.reshape(blocks, -1), again.reshape(blocks, -1)
        for i in range(0, len(ids), 256):
            part = ids[i : i + 256]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array([s[j].tobytes() for j in part], pa.binary()), pa.array([a[j].tobytes() for j in part], pa.binary())],
                ["__fblock", "__seen", "__again"],
            )

    def merge(batches):
        now, seen, again = None, None, None
        for batch in batches:
            out = []
            for block, s, a in zip(*(c.to_pylist() for c in batch.columns)):
                s, a = np.frombuffer(s, np.uint8), np.frombuffer(a, np.uint8)
                if block != now:
                    if now is not None and again.any():
                        out.append((now, again.tobytes()))
                    now, seen, again = block, s.copy(), a.copy()
                else:
                    again |= a | (seen & s)
                    seen |= s
            yield _filter_rows(out)
        yield _filter_rows([(now, again.tobytes())] if now is not None and again.any() else [])

    marked = at.mapInArrow(mark, "__fblock int, __seen binary, __again binary")
    return marked.repartition("__fblock").sortWithinPartitions("__fblock").mapInArrow(merge, "__fblock int, __bits binary")


def maybe_repeated(table: DataFrame, key: Column, most_bits: int = MAX_FILTER_BITS, bits_per_row: int = 32) -> DataFrame:
    """Adds __maybe to a written table: false only where no other row has the key.

    Where all rows' filter would outgrow ``most_bits``, the table is dealt to passes by another hash of the
    key, each with a filter of its own for its rows, built, broadcast and written before the next: however many
    rows there are, a filter keeps its bits a row, and rows that occur once pass. Equal keys share a pass.
    """
    rows = table.count()
    passes = max(1, -(-rows * bits_per_row // most_bits))

    def tested(part: DataFrame) -> DataFrame:
        blocks = filter_blocks(-(-rows // passes), bits_per_row)
        return maybe_in(part, key, repeat_filter(part, key, blocks), blocks)

    if passes == 1:
        return tested(table)
    dealt = cut(table.withColumn("__pass", F.pmod(F.xxhash64(key, F.lit(2)), F.lit(passes)).cast("int")), "passes", "__pass")
    spark, path = table.sparkSession, f"{shared_dir(table.sparkSession)}/rankspark/tested-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    out = None
    for i in range(passes):
        out = tested(dealt.where(F.col("__pass") == i).drop("__pass"))
        out.write.option("compression", "zstd").parquet(f"{path}/pass={i}")
    release(dealt)
    return spark.read.schema(out.schema).parquet(path).drop("pass")


def _filter_rows(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["__fblock", "__bits"])


def drop_ids(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key isn't in ``gone``. A Bloom filter passes most rows straight
    through; only those that may be gone shuffle to the exact anti-join. Null keys stay."""
    blocks = filter_blocks(gone.count())
    gone = gone.select(F.col(key).alias("gone"))
    at = df.select(whole(df).alias("row"), F.col(f"`{key}`").alias("key"))
    tested = maybe_in(at, F.col("key"), membership_filter(gone, F.col("gone"), blocks), blocks)
    doubt = tested.where("__maybe")
    return tested.where("not __maybe").select("row.*").union(doubt.join(gone, F.col("key") == F.col("gone"), "left_anti").select("row.*"))


# --- Prefix scan ------------------------------------------------------------------------


def prefix_sums(df: DataFrame, order: str, value: str, out: str, run: int = 4096) -> DataFrame:
    """Exclusive running sum of ``value`` by the dense integer ``order``, in two levels.

    Runs of ``run`` rows are summed, the sums are scanned, and each run is scanned from
    its own start, so that no task sees more than ``run`` rows or the run totals.
    """
    at = df.withColumn("__run", F.expr(f"{order} div {run}"))
    totals = at.groupBy("__run").agg(F.sum(value).alias("__total"))
    before = totals.select(
        F.col("__run").alias("__r"),
        F.coalesce(F.sum("__total").over(Window.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
    )
    own = Window.partitionBy("__run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("__own", F.coalesce(F.sum(value).over(own), F.lit(0)))
    return at.join(before, F.col("__run") == F.col("__r")).withColumn(out, (F.col("__own") + F.col("__before")).cast("long")).drop("__run", "__r", "__own", "__before")
