"""Token counts of documents in flat token files, by a scan for separators.

A flat file is a run of token ids without an index; an end-of-document id closes each
document. Files are read in blocks. Each block is searched for separators with vectorised
comparisons, on its own. A prefix scan over the blocks' summaries then stitches the
documents that cross block boundaries: it carries the number of documents closed so far
and the tokens since the last separator.

Defined results: the separator isn't counted; two separators in a row enclose a document
of no tokens; tokens after the last separator are a document of their own, with ``closed``
false. A null or empty block has no tokens. An empty table gives no document. The
separator's string in a text is ordinary text, so that it closes no document. Only the two
named columns are read, so no other column's name can clash.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, bounded_batches
from .tokens import END_OF_TEXT, VOCABULARY, encoder, id_bytes

BLOCK_TOKENS = 1 << 16


#: A task reads about so many blocks of files.
TASK_BLOCKS = 512


def _open(path: str):
    scheme, _, rest = path.partition(":")
    if scheme == "file" or not rest:
        return pafs.LocalFileSystem().open_input_file("/" + (rest or path).lstrip("/"))
    system, at = pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
    return system.open_input_file(at)


def read_token_files(spark: SparkSession, path: str, id_bytes: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks (file, block, ids) of flat files of little-endian ids under a path.

    Only names and lengths are listed; each block is a byte range that its task seeks and
    reads, so one file of any size is read by many tasks.
    """
    step = block_tokens * id_bytes
    files = spark.read.format("binaryFile").load(path).where("length > 0").select(F.col("path").alias("file"), F.expr(f"(length - 1) div {step}").alias("last"))
    total = files.agg(F.sum(F.col("last") + 1)).first()[0] or 0
    ranges = files.select("file", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("block")).repartition(total // TASK_BLOCKS + 1, "file", "block")

    def run(batches):
        name, file = None, None
        for batch in batches:
            for f, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if f != name:
                    name, file = f, _open(f)
                file.seek(block * step)
                yield pa.RecordBatch.from_arrays([pa.array([f]), pa.array([block], pa.int64()), pa.array([file.read(step)], pa.binary())], ["file", "block", "ids"])

    return ranges.sortWithinPartitions("file", "block").mapInArrow(run, "file string, block bigint, ids binary")


def flat_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, end: int = END_OF_TEXT, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """Tokenises ``docs`` to one flat file for each partition. Two tables: blocks of bare ids
    (file, block, ids), and whose the documents of a file are (file, ordinal, owner).

    The blocks are rows of a written table, so that lost tasks and every file system are
    Spark's own matter; they say nothing of the documents in them.
    """
    bounded_batches(docs.sparkSession)
    kind, width = docs.schema[id_col].dataType.simpleString(), f"<u{id_bytes(vocabulary)}"
    names = ["file", "block", "ids", "ordinal", "owner"]

    def run(batches):
        encode, held, n, block, done, file, owner = encoder(vocabulary, added=False), [], 0, 0, 0, None, None

        def out(ids):
            return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, owner)], names)

        for batch in batches:
            if not len(batch):
                continue
            file, owner = str(batch.column(2)[0].as_py()), batch.schema.field(0).type
            rows = len(batch)
            yield pa.RecordBatch.from_arrays([pa.array([file] * rows), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.binary()), pa.array(range(done, done + rows), pa.int64()), batch.column(0)], names)
            done += rows
            for text in batch.column(1):
                held.append(np.append(np.frombuffer(encode(text.as_py() or ""), "<u4"), end).astype(width))
                n += len(held[-1])
                if n >= block_tokens:
                    ids = np.concatenate(held)
                    for _ in range(n // block_tokens):
                        yield out(ids[:block_tokens])
                        ids, block = ids[block_tokens:], block + 1
                    held, n = [ids], len(ids)
        if n:
            yield out(np.concatenate(held))

    at = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.spark_partition_id().alias("file"))
    table = cut(at.mapInArrow(run, f"file string, block bigint, ids binary, ordinal bigint, owner {kind}"), "flat-files")
    return table.where("block is not null").select("file", "block", "ids"), table.where("ordinal is not null").select("file", "ordinal", "owner")


def scan(blocks: DataFrame, end: int = END_OF_TEXT, id_bytes: int = 2) -> DataFrame:
    """file, block, n (ids in the block) and ends (places of separators in it)."""

    def run(batches):
        for batch in batches:
            ids = [np.frombuffer(x.as_py() or b"", f"<u{id_bytes}") for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([len(x) for x in ids], pa.int64()), pa.array([np.flatnonzero(x == end).astype(np.int32) for x in ids], pa.list_(pa.int32()))],
                ["file", "block", "n", "ends"],
            )

    return blocks.select("file", "block", "ids").mapInArrow(run, "file string, block bigint, n bigint, ends array<int>")


def stitch(scanned: DataFrame, run: int = 4096) -> DataFrame:
    """file, ordinal, start (place of the document's first id in the file), n_tokens, closed.

    The scan is in two levels: within runs of blocks, then over the runs' sums, so that no
    task holds the blocks of a whole file.
    """
    at = scanned.withColumn("__run", F.expr(f"block div {run}")).withColumn("__n", F.size("ends"))
    own = Window.partitionBy("file", "__run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("file").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    runs = at.groupBy("file", "__run").agg(F.sum("n").alias("__ids"), F.sum("__n").alias("__docs"))
    runs = runs.select(F.col("file").alias("__f"), F.col("__run").alias("__r"), F.coalesce(F.sum("__ids").over(before), F.lit(0)).alias("__ids0"), F.coalesce(F.sum("__docs").over(before), F.lit(0)).alias("__docs0"))
    at = at.withColumn("__ids1", F.coalesce(F.sum("n").over(own), F.lit(0))).withColumn("__docs1", F.coalesce(F.sum("__n").over(own), F.lit(0)))
    at = at.join(runs, F.col("file").eqNullSafe(F.col("__f")) & (F.col("__run") == F.col("__r")))
    at = at.withColumn("__base", (F.col("__ids0") + F.col("__ids1")).cast("long")).withColumn("__first", (F.col("__docs0") + F.col("__docs1")).cast("long"))
    # the last separator of any block before: the same two levels
    last = at.withColumn("__last", F.when(F.col("__n") > 0, F.col("__base") + F.element_at("ends", -1)))
    ends = last.groupBy("file", "__run").agg(F.max("__last").alias("__end"))
    ends = ends.select(F.col("file").alias("__f2"), F.col("__run").alias("__r2"), F.max("__end").over(before).alias("__end0"))
    last = last.withColumn("__end1", F.max("__last").over(own)).drop("__f", "__r").join(ends, F.col("file").eqNullSafe(F.col("__f2")) & (F.col("__run") == F.col("__r2")))
    last = last.withColumn("__open", F.coalesce(F.greatest("__end0", "__end1"), F.lit(-1)) + 1)
    found = last.select("file", "__first", "__base", "__open", "ends", F.posexplode("ends").alias("__k", "__at"))
    start = F.when(F.col("__k") == 0, F.col("__open")).otherwise(F.col("__base") + F.element_at("ends", F.greatest(F.col("__k"), F.lit(1))) + 1)
    closed = found.withColumn("start", start).select(
        "file", (F.col("__first") + F.col("__k")).alias("ordinal"), "start", (F.col("__base") + F.col("__at") - F.col("start")).alias("n_tokens"), F.lit(True).alias("closed"),
    )
    whole = last.groupBy("file").agg(F.max(F.col("__base") + F.col("n")).alias("__all"), F.max(F.greatest("__open", F.coalesce(F.col("__last") + 1, F.lit(0)))).alias("start"), F.max(F.col("__first") + F.col("__n")).alias("ordinal"))
    rest = whole.where(F.col("__all") > F.col("start")).select("file", "ordinal", "start", (F.col("__all") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, file, ordinal, start, n_tokens of each row of ``docs``, laid out as flat files."""
    blocks, owners = flat_files(docs, id_col, text_col, vocabulary=vocabulary)
    found = stitch(cut(scan(blocks, id_bytes=id_bytes(vocabulary)), "scanned"))
    owners = owners.select(F.col("file").alias("f"), F.col("ordinal").alias("o"), "owner")
    return found.join(owners, (F.col("file") == F.col("f")) & (F.col("ordinal") == F.col("o"))).select(F.col("owner").alias(id_col), "file", "ordinal", "start", "n_tokens")
