"""SimHash near-dedup by multi-index hashing.

A fingerprint has 64 bits, one vote for each word shingle's XXH64. Fingerprints link at
``DISTANCE`` or fewer differing bits. The 64 bits are two segments of 32; two linked
fingerprints differ by at most one bit in one of them. Each fingerprint is in a table by
the value of either segment, the ball of values within one bit is looked up there, and the
complete distance is checked on each match. Links become components by alternating stars.

Only distinct fingerprints are joined, so a group of equal texts counts once.

Defined results: a null or blank text has no words and fingerprint zero, linked like any
other; a text of one or two words has one shingle, the whole sequence. component_id is the
smallest id that isn't null in the component (null if it has none). Rows that repeat keep
one output row each. An empty table gives an empty table. Other columns pass through
untouched, or aren't read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, drop_ids, release

SHINGLE = 3
SEED = 42
DISTANCE = 2
SEGMENT = 32
#: Keys with over one in so many rows of a lookup are dealt to several tasks.
PIECES = 1024


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """64 bits as a signed integer; a bit is 1 if set in over half of the shingles' hashes."""
    words = (text or b"").lower().split()  # bytes: lowers A-Z and splits at ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(width, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest, n = xxhash.xxh64_intdigest, len(starts)
    votes = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 15):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + (1 << 15)], ends[i : i + (1 << 15)])], np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, fp) for each row of ``docs``."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a, b) of different fingerprints of ``fps`` (column fp, distinct) within ``distance`` <= 3.

    Of two values that differ in one bit, the one without the bit looks up the other, so
    a ball costs half its size in lookups.
    """
    values = F.array(
        F.struct(F.lit(0).alias("segment"), F.col("fp").bitwiseAND(F.lit((1 << SEGMENT) - 1)).alias("value")),
        F.struct(F.lit(1).alias("segment"), F.shiftrightunsigned("fp", SEGMENT).alias("value")),
    )
    table = fps.select("fp", F.explode(values).alias("at")).select("fp", "at.segment", "at.value")
    bits = [F.when(F.col("value").bitwiseAND(F.lit(1 << i)) == 0, F.col("value").bitwiseOR(F.lit(1 << i))) for i in range(SEGMENT)]
    ball = table.select(F.col("fp").alias("probe"), F.col("segment").alias("s"), F.explode(F.array_compact(F.array(F.col("value"), *bits))).alias("v"), F.col("value").alias("own"))
    met = ball.join(
        table,
        (F.col("s") == F.col("segment"))
        & (F.col("v") == F.col("value"))
        & (F.bit_count(F.col("probe").bitwiseXOR(F.col("fp"))) <= distance)
        & ((F.col("v") != F.col("own")) | (F.col("probe") < F.col("fp"))),
    )
    return met.select(F.least("probe", "fp").alias("a"), F.greatest("probe", "fp").alias("b"))


def looked_up(rows: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``found`` for their key. found: written, one row for each key,
    n of them in ``rows`` at most.

    A key with over a PIECES-th of all rows is hot: its rows are dealt to several tasks by a
    salt, and its row of ``found`` goes to each. Fewer than PIECES keys are hot, so their list
    can be broadcast.
    """
    limit = max(64, (found.agg(F.sum("n")).first()[0] or 0) // PIECES)
    salts = F.ceil(F.col("n") / limit).cast("int")
    hot = F.broadcast(found.where(F.col("n") > limit).select(F.col(key).alias("hot"), salts.alias("salts")))
    dealt = rows.join(hot, F.col(key) == F.col("hot"), "left").withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.coalesce("salts", F.lit(1))).cast("int")).drop("hot", "salts")
    each = found.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n")
    return dealt.join(each, [key, "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected ``edges`` (a, b); root: the least node.

    Alternates large stars and small stars until nothing changes: a logarithmic number of
    rounds, each a grouped minimum and a lookup of it, written to the shared folder. A round's tables
    are deleted when its links are written.
    """
    edges, before = cut(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"), None
    while True:
        last, both = edges, edges.union(edges.select("b", "a"))
        low = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n")), "low")
        stars = cut(looked_up(both.where("b > a"), "a", low).select(F.col("m").alias("a"), "b").where("a != b").distinct(), "large-stars")
        nearest = cut(stars.groupBy("b").agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("n")), "low")
        hung = looked_up(stars, "b", nearest)
        edges = hung.select(F.col("m").alias("a"), "b").union(hung.where("a != m").select("m", "a")).distinct()
        edges = cut(edges, "stars")
        release(last, low, stars, nearest)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select("a", "a").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for each row of ``docs``."""
    prints = cut(fingerprints(docs, id_col, text_col), "fingerprints")
    fps = prints.groupBy("fp").agg(F.min("id").alias("least_id"))
    roots = components(links(fps.select("fp")))
    grown = fps.join(roots, fps.fp == roots.node)
    least = cut(grown.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "least")
    linked = looked_up(roots, "root", least).select("node", "component_id")
    named = fps.join(linked, fps.fp == linked.node, "left").select(F.col("fp").alias("of"), F.coalesce("component_id", "least_id").alias("component_id"))
    # written, so that both sides of the join are exchanges and a hot fingerprint's rows are split
    named = cut(named, "named")
    out = prints.join(named, prints.fp == named.of).select("id", "fp", "component_id")
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id.

    Rows with a null id stay unless their group has an id; of rows that share the id that
    stays, all stay (drop exact copies first).
    """
    found = cut(near_duplicates(docs, id_col, text_col), "near")
    gone = found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return drop_ids(docs, cut(gone, "gone"), id_col)


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
