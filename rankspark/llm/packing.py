"""Packing: concatenate and cut.

Pass one tokenises each partition, writes its documents with their offset inside the
partition, and totals the partition. Prefix sums over the totals give each partition its
global offset. Pass two cuts the ids at multiples of the window; a document that crosses a
boundary gets one record for each side.

Only the last sequence can be short. It is padded to the window unless its length is a
power of two, and padding needs no record.

Added tokens of the vocabulary are matched in a text, as tokenizers does by default.

Defined results: a null text is empty, and an empty document is the end id alone. Rows
that repeat are packed as often as they occur. Null ids stay null. An empty table gives no
piece. Only the two named columns are read, so no other column's name can clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, bounded_batches
from .tokens import VOCABULARY, encoder, id_bytes

WINDOW = 1024
END = 0


def tokenised(docs: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """part, start (ids before it in the part), id, n, ids: the end id included, id_bytes() each."""
    bounded_batches(docs.sparkSession)
    kind, width = docs.schema[id_col].dataType.simpleString(), f"<u{id_bytes(vocabulary)}"

    def run(batches):
        encode, start = encoder(vocabulary), 0
        for batch in batches:
            part, starts, sizes, ids = batch.column(2), [], [], []
            for text in batch.column(1):
                got = np.frombuffer(encode(text.as_py() or ""), "<u4")
                got = np.append(got, end).astype(width)
                starts.append(start)
                sizes.append(len(got))
                ids.append(got.tobytes())
                start += len(got)
            yield pa.RecordBatch.from_arrays([part, pa.array(starts, pa.int64()), batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], ["part", "start", "id", "n", "ids"])

    at = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.spark_partition_id().alias("part"))
    return at.mapInArrow(run, f"part int, start bigint, id {kind}, n bigint, ids binary")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each piece: id, start, length, ids (32-bit little-endian), doc_tokens,
    sequence_id, offset."""
    tokens = cut(tokenised(docs, id_col, text_col, vocabulary), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition of the input
    offsets = totals.select(F.col("part").alias("__part"), F.coalesce(F.sum("total").over(before), F.lit(0)).cast("long").alias("base"))
    at = tokens.join(F.broadcast(offsets), F.col("part") == F.col("__part")).select("id", (F.col("base") + F.col("start")).alias("first"), "n", "ids")
    kind, width = docs.schema[id_col].dataType.simpleString(), f"<u{id_bytes(vocabulary)}"

    def run(batches):
        for batch in batches:
            rows = [[] for _ in range(6)]
            whose = []
            for k, (first, n, ids) in enumerate(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))):
                wide = np.frombuffer(ids, width).astype("<u4")
                done = 0
                while done < n:
                    sequence, offset = divmod(first + done, window)
                    length = min(window - offset, n - done)
                    whose.append(k)
                    for to, v in zip(rows, (done, length, wide[done : done + length].tobytes(), n, sequence, offset)):
                        to.append(v)
                    done += length
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(whose, pa.int64())), *(pa.array(r, t) for r, t in zip(rows, kinds))],
                ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    out = at.mapInArrow(run, f"id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("id", id_col)
