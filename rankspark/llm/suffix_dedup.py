"""Suffix-array dedup: removes each byte of a 400-byte string that also starts elsewhere.

A window is a 400-byte string. A suffix at every byte would move dozens of times the corpus,
so windows are sorted in runs, then the few that a run doesn't settle in shorter runs, then
one by one; each time the sort decides.

1. Anchors. Each window has an anchor, the place in it of the least hash of 32 bytes
   (leftmost if several). It depends on the window's content alone, so two equal windows
   have their anchors at the same distance from their starts. Some 120 windows in a row
   share an anchor.
2. Runs. An anchor's windows are cut into runs at fixed distances. A run's core is what
   all its windows share, its hull what they cover together. If no other run has its core, no
   window of the run recurs. If another has its hull, all of them do.
3. The sort. A run is the suffix at its core's first byte, and travels as its document and
   offset with a key: the suffix's leading 32 bytes, then 128 bits each for the rest of the
   core and for the hull. Sampled splitters range-partition the keys, each bucket sorts its
   own by multikey quicksort, and neighbours are compared, across buckets too: runs that
   agree with a neighbour in core and hull recur, those that agree in neither don't.
4. Runs that agree in the core only go on: their bytes are read again, and they are cut to
   runs of a few windows and sorted, and what is left of these to windows, whose key is all
   their 400 bytes.

The sort never gathers a key's rows: the splitters cut a hot key too, and only each bucket's
first and last row are held against other buckets.

Defined results: a null text is empty; texts under 400 bytes lose nothing. Rows that
repeat (equal id and text, null ids included) count as separate documents, so each loses
whatever a window covers. An empty table gives an empty table. Documents keep their order
of bytes; a cut inside a multi-byte character leaves the rest of its bytes. Only the two
named columns are read, so no other column's name can clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, filter_blocks, maybe_in, membership_filter, release, worker_cache

LENGTH = 400
GRAM = 32
#: Widths of runs, in windows: of the whole corpus, then of what is left.
WIDE, NARROW = 123, 6
#: A run's key: leading bytes of its suffix, then digests of core and hull.
LEAD, DIGEST = 32, 16
#: A bucket of the sort holds keys of about so many bytes.
BUCKET_BYTES = 16 << 20
#: Long texts are hashed in pieces of so many windows.
PIECE = 1 << 20
_P = 0x9E3779B97F4A7C15
_MIX = 0xD6E8FEB86659FD93


def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = PIECE + LENGTH + 1
    up, down = np.full(n, _P, np.uint64), np.full(n, pow(_P, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """High halves of mixed hashes of all ``gram``-byte strings, as uint64."""
    up, down = worker_cache("powers", _powers)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    h = (total[gram:] - total[:-gram]) * down[: len(data) - gram + 1]
    h *= np.uint64(_MIX)
    h ^= h >> np.uint64(32)
    h *= np.uint64(_MIX)
    return h & np.uint64(0xFFFFFFFF00000000)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` keys in a row: running minima of blocks, both ways."""
    n = len(keys)
    full = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64)
    full[:n] = keys
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM, piece: int = PIECE):
    """Arrays (anchor, first, last): windows that start at first to last have that anchor."""
    found = []
    width = length - gram + 1
    for at in range(0, len(text) - length + 1, piece):
        data = np.frombuffer(text, np.uint8, offset=at, count=min(piece + length - 1, len(text) - at))
        keys = _gram_hashes(data, gram)
        keys |= np.arange(len(keys), dtype=np.uint64)
        place = (_least(keys, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        found.append((place[new] + at, new + at, np.append(new[1:], len(place)) - 1 + at))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    place, first, last = (np.concatenate(x) for x in zip(*found))
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))  # pieces may share an anchor
    return place[new], first[new], last[np.append(new[1:], len(place)) - 1]


def _digest(data: bytes, *more: int) -> bytes:
    return xxhash.xxh3_128_digest(data, seed=sum((v + 1) << (12 * i) for i, v in enumerate(more)))


def _runs(text: bytes, a: int, near: int, far: int, width: int, length: int):
    """Runs of the anchor at text[a]: (run, nearest, farthest, key) for the distances
    near..far from a window's start to the anchor."""
    for run in range(near // width, far // width + 1):
        d1, d2 = run * width, min(run * width + width, length) - 1
        start, end = max(0, a - d2), min(len(text), a + length - d1)
        core = text[a - d1 : a + length - d2]
        # a hull that the document's ends cut short only equals one cut in the same way
        key = core[:LEAD].ljust(LEAD, b"\0") + _digest(core, run % 4096) + _digest(text[start:end], a - start, end - a)
        yield run, max(near, d1), min(far, d2), key


def _key(id_col: str, text_col: str) -> list[Column]:
    return [F.coalesce(F.xxhash64(F.col(id_col)), F.lit(0)).alias("k1"), F.xxhash64(text_col).alias("k2")]


def _wide_runs(docs: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = [[] for _ in range(7)]
            for k1, k2, text in zip(*(c.to_pylist() for c in batch.columns)):
                if text is None or len(text) < length:
                    continue
                for a, first, last in zip(*(x.tolist() for x in anchors(text, length))):
                    for r, near, far, key in _runs(text, a, a - last, a - first, WIDE, length):
                        for to, v in zip(out, (k1, k2, a, r, near, far, key)):
                            to.append(v)
                if len(out[0]) > 50_000:
                    yield _run_rows(out)
                    out = [[] for _ in range(7)]
            yield _run_rows(out)

    return docs.select("k1", "k2", F.col("text").cast("binary").alias("text")).mapInArrow(run, _RUN_SCHEMA)


_RUN = ["k1", "k2", "anchor", "run", "near", "far"]
_RUN_SCHEMA = "k1 bigint, k2 bigint, anchor bigint, run int, near int, far int, key binary"


def _run_rows(out: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], [*_RUN, "key"])


def _contexts(docs: DataFrame, open_: DataFrame, length: int) -> DataFrame:
    """Open runs with the bytes of their hulls: context (a number), k1, k2, anchor, near, far,
    left, bytes. left: the bytes before the anchor. Only documents with open runs shuffle."""
    wanted = open_.groupBy(F.col("k1").alias("w1"), F.col("k2").alias("w2")).agg(F.collect_set(F.struct("anchor", "near", "far")).alias("runs"))
    at = _those_in(docs, wanted).join(wanted, (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2")))
    at = at.select("k1", "k2", F.col("text").cast("binary").alias("text"), F.explode("runs").alias("r"))
    start = F.greatest(F.lit(0), F.col("r.anchor") - F.col("r.far"))
    end = F.col("r.anchor") + length - F.col("r.near")
    piece = F.substring(F.col("text"), (start + 1).cast("int"), (end - start).cast("int"))
    return at.select(F.monotonically_increasing_id().alias("context"), "k1", "k2", "r.anchor", "r.near", "r.far", (F.col("r.anchor") - start).cast("int").alias("left"), piece.alias("bytes"))


def _those_in(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``docs`` that a bounded Bloom filter can't rule out of ``wanted`` (w1, w2)."""
    blocks = filter_blocks(wanted.count())
    filt = membership_filter(wanted.select(F.xxhash64("w1", "w2").alias("w")), F.col("w"), blocks)
    return maybe_in(docs, F.xxhash64("k1", "k2"), filt, blocks).where("__maybe").drop("__maybe")


def _narrow_runs(contexts: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            out, whose = [[] for _ in range(7)], []
            for context, k1, k2, anchor, near, far, left, data in zip(*(c.to_pylist() for c in batch.columns)):
                for r, n, f, key in _runs(data, left, near, far, NARROW, length):
                    for to, v in zip(out, (k1, k2, anchor, r, n, f, key)):
                        to.append(v)
                    whose.append(context)
            rows = _run_rows(out)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(whose, pa.int64())], [*rows.schema.names, "context"])

    return contexts.mapInArrow(run, f"{_RUN_SCHEMA}, context bigint")


def _windows(open_: DataFrame, contexts: DataFrame, length: int) -> DataFrame:
    """One row for each window of the open runs, as a run of its own; its key is its bytes.
    Only contexts with open runs shuffle."""
    blocks = filter_blocks(open_.count())
    some = maybe_in(contexts.select(F.col("context").alias("c"), "left", "bytes"), F.col("c"), membership_filter(open_, F.col("context"), blocks), blocks).where("__maybe").drop("__maybe")
    at = open_.join(some, F.col("context") == F.col("c")).withColumn("d", F.explode(F.sequence("near", "far")))
    key = F.substring(F.col("bytes"), F.col("left") - F.col("d") + 1, F.lit(length))
    return at.select("k1", "k2", "anchor", "run", F.col("d").alias("near"), F.col("d").alias("far"), key.alias("key"), "context")


def multikey_order(rows: np.ndarray) -> np.ndarray:
    """Order of equally long byte strings (rows of a matrix) by multikey quicksort.

    Each group of rows that agree so far is split by its middle row's next word of eight
    bytes into the rows under it, equal to it and over it. Equal ones go on with the word
    after. All groups take a step at once; groups of one row are done.
    """
    words = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8)))).view(">u8").astype(np.uint64)
    order = np.arange(len(rows))
    # rows in groups of two or more: their places in the order, each group's first, size and word
    place, first, size, word = order.copy(), np.zeros(1, np.int64), np.array([len(rows)]), np.zeros(1, np.int64)
    if len(rows) < 2:
        return order
    while len(place):
        group = np.repeat(np.arange(len(first)), size)
        at = order[place]
        value = words[at, word[group]]
        pivot = value[first + size // 2][group]
        sides = [value < pivot, value == pivot, value > pivot]
        sums = [np.concatenate([[0], np.cumsum(s)]) for s in sides]
        last = first + size
        counts = np.stack([c[last] - c[first] for c in sums], axis=1)
        begin = (np.cumsum(counts.ravel()) - counts.ravel()).reshape(-1, 3)
        to = np.empty(len(place), np.int64)
        for k in range(3):
            i = np.flatnonzero(sides[k])
            to[i] = (begin[:, k] - sums[k][first])[group[i]] + sums[k][i]
        moved = np.empty_like(at)
        moved[to] = at
        order[place] = moved
        step = np.stack([word, word + 1, word], axis=1).ravel()
        counts = counts.ravel()
        goes_on = (counts > 1) & (step < words.shape[1])
        place = place[np.repeat(goes_on, counts)]
        size, word = counts[goes_on], step[goes_on]
        first = np.cumsum(size) - size
    return order


def _groups(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each sorted row's group of equal rows, sizes of the groups)."""
    group = np.concatenate([[0], np.cumsum((rows[1:] != rows[:-1]).any(axis=1))])
    return group, np.bincount(group)


def _sort(runs: DataFrame, core: int, carry: list[str], name: str) -> DataFrame:
    """The runs that have a neighbour with their core (the first ``core`` bytes of the key) in
    the sorted order, with ``recurs`` (one has the whole key too) and ``open``: of the runs with
    one key, one goes on as a witness, if others have its core. Takes over the written table
    ``runs``, which is deleted."""
    spark, n = runs.sparkSession, runs.count()
    first = runs.select(F.octet_length("key")).first()
    width = first[0] if first else core
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * width // BUCKET_BYTES + 1)
    names = [*_RUN, *carry]
    # splitters are sampled from the keys; the salt lets them cut a hot key too
    salted = runs.withColumn("salt", F.xxhash64(*_RUN).bitwiseAND(F.lit(1023)).cast("int"))
    dealt = salted.repartitionByRange(buckets, "key", "salt").select(*names, "key", F.spark_partition_id().alias("bucket"))

    def run(batches):
        held = [batch for batch in batches if len(batch)]
        if not held:
            return
        t = pa.Table.from_batches(held)
        rows = np.frombuffer(b"".join(t.column("key").to_pylist()), np.uint8).reshape(len(t), -1)
        order = multikey_order(rows)
        rows = rows[order]
        by_core, core_sizes = _groups(rows[:, :core])
        by_key, key_sizes = _groups(rows)
        met, recurs = core_sizes[by_core] > 1, key_sizes[by_key] > 1
        leads = np.concatenate([[True], by_key[1:] != by_key[:-1]])
        keys_of_core = np.bincount(by_core[leads])
        # the groups at both ends may go on in other buckets, with other keys
        several = (keys_of_core[by_core] > 1) | (by_core == 0) | (by_core == by_core[-1])
        at_end = np.zeros(len(order), bool)
        at_end[[0, -1]] = True
        keep = np.flatnonzero(met | at_end)
        plain = t.select([*names, "bucket"])
        for i in range(0, len(keep), 10_000):
            k = keep[i : i + 10_000]
            got = plain.take(pa.array(order[k]))
            ends = [rows[j].tobytes() if e else None for j, e in zip(k.tolist(), at_end[k].tolist())]
            yield pa.RecordBatch.from_arrays(
                [*(c.combine_chunks() for c in got.columns), pa.array(met[k]), pa.array(recurs[k]), pa.array((leads & several)[k]), pa.array(ends, pa.binary())],
                [*names, "bucket", "met", "recurs", "open", "end"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in runs.schema}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in names), "bucket int, met boolean, recurs boolean, open boolean, end binary"])
    found = cut(dealt.mapInArrow(run, schema), name)
    release(runs)
    # two rows at most of each bucket: equal ends meet across buckets' boundaries
    ends = found.where("end is not null").select(*names, "bucket", "met", "recurs", F.substring("end", 1, core).alias("core"), "end")

    def across(of: str) -> DataFrame:
        met = ends.groupBy(F.col(of).alias(f"{of}_met")).agg(F.min("bucket").alias("low"), F.max("bucket").alias("high"))
        return met.where("low < high").select(f"{of}_met")

    joined = ends.join(across("core"), F.col("core") == F.col("core_met"), "left").join(across("end"), F.col("end") == F.col("end_met"), "left")
    joined = joined.where("met or core_met is not null").select(*names, (F.col("recurs") | F.col("end_met").isNotNull()).alias("recurs"), F.lit(True).alias("open"))
    return found.where("end is null").select(*names, "recurs", "open").unionByName(joined)


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(k1, k2, spans): byte ranges to remove, merged, of keyed documents (k1, k2, text)."""
    bounded_batches(docs.sparkSession)
    wide = _sort(cut(_wide_runs(docs, length), "runs"), LEAD + DIGEST, [], "wide")
    contexts = cut(_contexts(docs, wide.where("open"), length), "contexts")
    narrow = _sort(cut(_narrow_runs(contexts, length), "narrow"), LEAD + DIGEST, ["context"], "shorter")
    one = _sort(cut(_windows(narrow.where("open"), contexts, length), "windows"), length, ["context"], "sorted")
    starts = wide.where("recurs").select(*_RUN).unionByName(narrow.where("recurs").select(*_RUN)).unionByName(one.where("recurs").select(*_RUN))
    starts = starts.select("k1", "k2", (F.col("anchor") - F.col("far")).alias("s"), (F.col("anchor") - F.col("near") + length).alias("e")).distinct()
    # islands of overlapping ranges, then one row for each document
    order = Window.partitionBy("k1", "k2").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    at = starts.withColumn("new", F.when(reach >= F.col("s"), 0).otherwise(1))
    at = at.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    islands = at.groupBy("k1", "k2", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return islands.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("id", "text", *_key("id", "text"))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """id, n_bytes, spans (removed byte ranges) and kept (remaining bytes) of each row."""
    at = keyed(docs, id_col, text_col)
    spans = cut(repeated_spans(at, length), "spans")
    wanted = spans.select(F.col("k1").alias("w1"), F.col("k2").alias("w2"), "spans")
    blocks = filter_blocks(spans.count())
    filt = membership_filter(wanted.select(F.xxhash64("w1", "w2").alias("w")), F.col("w"), blocks)
    tested = maybe_in(at, F.xxhash64("k1", "k2"), filt, blocks)
    none = F.lit(None).cast("array<struct<s:bigint,e:bigint>>")
    whole = tested.where("not __maybe").select("id", "text", none.alias("spans"))
    met = tested.where("__maybe").join(wanted, (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2")), "left").select("id", "text", "spans")
    both = whole.unionByName(met).select("id", F.col("text").cast("binary").alias("b"), F.coalesce("spans", F.array().cast("array<struct<s:bigint,e:bigint>>")).alias("spans"))
    # the gaps between spans are what stays
    lows = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda x: x["e"]))
    highs = F.concat(F.transform("spans", lambda x: x["s"]), F.array(F.octet_length("b").cast("long")))
    gaps = F.zip_with(lows, highs, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    joined = F.unhex(F.array_join(F.transform(gaps, lambda g: F.hex(F.substring(F.col("b"), (g["a"] + 1).cast("int"), (g["b"] - g["a"]).cast("int")))), ""))
    out = both.select("id", F.octet_length("b").cast("long").alias("n_bytes"), "spans", F.when(F.size("spans") == 0, F.col("b")).otherwise(joined).alias("kept"))
    return out.withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_bytes (before removal), n_removed, n_spans and kept_sha256 of each row, then what stays
    as ``documents`` has it: text (a character cut in two shows as U+FFFD) and n_chars."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["e"] - x["s"])
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    at = found.select(id_col, "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), text.alias("text"))
    return at.withColumn("n_chars", F.char_length("text").cast("long"))


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text, by a table of all windows."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = 1
        n_spans = int((np.diff(np.concatenate([[0], gone])) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest()))
    return out
