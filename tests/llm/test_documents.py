"""Operators over documents against brute force, on rows with every awkward case."""

import collections
import hashlib
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from rankspark.llm import common, exact_dedup, langid, mixing, packing, simhash, suffix_dedup, token_scan


def collect(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# --- simhash -----------------------------------------------------------------------------


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def brute_components(fps):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if bin(a ^ b).count("1") <= 2:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def test_near_duplicates(docs, rows):
    got = sorted(collect(simhash.near_duplicates(docs).withColumn("hex", simhash.hex_fingerprint("fp")), "doc_id", "hex", "component_id"), key=str)
    prints = [(r[0], brute_fingerprint(r[1])) for r in rows]
    root = brute_components({f for _, f in prints})
    least = collections.defaultdict(list)
    for i, f in prints:
        least[root[f]].append(i)
    least = {k: min([i for i in v if i is not None], default=None) for k, v in least.items()}
    assert got == sorted([(i, f"{f:016x}", least[root[f]]) for i, f in prints], key=str)


def test_links_cover_all_close_pairs(spark):
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for _ in range(6):
            fps.add(b ^ sum(1 << j for j in rng.sample(range(64), rng.randint(1, 3))))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {(r[0], r[1]) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    assert got == {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2}


def test_components_of_a_long_path(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (101, 100), (100, 101), (7, 7)], "a long, b long")
    got = {r[0]: r[1] for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}


def test_drop_near_duplicates_keeps_one_of_each(docs, rows):
    kept = [r[0] for r in collect(simhash.drop_near_duplicates(docs), "doc_id")]
    comp = {i: c for i, c in collect(simhash.near_duplicates(docs), "doc_id", "component_id") if i is not None}
    assert {i for i in kept if i is not None} == set(comp.values())


# --- exact dedup --------------------------------------------------------------------------


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_duplicate_groups(docs, rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[normal(r[1])].append(r[0])
    got = collect(exact_dedup.duplicate_groups(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    first = {t: min([i for i in v if i is not None], default=None) for t, v in groups.items()}
    expected = [(r[0], first[normal(r[1])], len(groups[normal(r[1])]), hashlib.sha256(normal(r[1]).encode()).hexdigest()) for r in rows]
    assert sorted([(a, b, c, e) for a, b, c, _, e in got], key=str) == sorted(expected, key=str)
    kept = [(a, e) for a, _, _, k, e in got if k]
    assert sorted(kept, key=str) == sorted([(first[t], hashlib.sha256(t.encode()).hexdigest()) for t in groups], key=str)


def test_small_filters_take_passes_and_pass_as_many_rows(spark, docs):
    """A filter of 32768 bits holds 1024 rows: more rows make more filters, and as few rows that occur once shuffle."""
    base = docs.sparkSession.range(12000).select(F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("k"))
    table = common.cut(base.union(base.where("id % 120 = 0")).union(base.where("id = 7").crossJoin(spark.range(500).select(F.lit(0).alias("x"))).select("id", "k")), "passes-test")
    shares = {}
    for bits in (1 << 15, common.MAX_FILTER_BITS):
        tested = common.maybe_repeated(table, F.col("k"), bits)
        assert tested.columns == ["id", "k", "__maybe"] and tested.count() == 12600
        doubt = tested.where("__maybe").groupBy("k").count()
        assert doubt.where("count > 1").count() == 101  # no repeated row passes
        shares[bits] = tested.where("__maybe").count()
    assert all(701 <= n <= 711 for n in shares.values())  # 701 rows do repeat
    one_filter = common.filter_blocks(1024)
    full = common.maybe_in(table, F.col("k"), common.repeat_filter(table, F.col("k"), one_filter), one_filter)
    assert full.where("__maybe").count() > 701 + 300  # one filter of that size for all rows
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    small, large = (sorted(collect(exact_dedup.duplicate_groups(docs, most_bits=b), *columns), key=str) for b in (1 << 10, common.MAX_FILTER_BITS))
    # of rows that tie on the id too, any may be the one that stays
    assert [x[:3] + x[4:] for x in small] == [x[:3] + x[4:] for x in large] and sum(x[3] for x in small) == sum(x[3] for x in large)


def test_drop_exact_duplicates(docs, rows):
    out = exact_dedup.drop_exact_duplicates(docs)
    assert out.columns == docs.columns
    first = {}
    for r in rows:
        t = normal(r[1])
        if t not in first or first[t] is None or r[0] is not None and r[0] < first[t]:
            first[t] = r[0]
    assert sorted(((i, normal(t)) for i, t in collect(out, "doc_id", "text")), key=str) == sorted(((i, t) for t, i in first.items()), key=str)


# --- language -------------------------------------------------------------------------------


def test_language(docs, rows):
    got = langid.identify(docs).select("doc_id", "text", "lang", "__lang", "__score").collect()
    assert len(got) == len(rows)
    for r in got:
        if not r.text or not any(c.isalpha() for c in r.text):
            assert r["__lang"] == "und" and r["__score"] == 0
        else:
            assert r["__lang"] in ("en", "de", "fr", "es") and 0 <= r["__score"] <= 1
    sure = [r for r in got if r.lang and r.text and len(r.text) > 60]
    assert sum(r["__lang"] == r.lang for r in sure) >= 0.97 * len(sure)
    held = [r for r in sure if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and sum(r["__lang"] == r.lang for r in held) >= 0.95 * len(held)


def test_language_without_labels(docs):
    from pyspark.sql import functions as F

    assert {r[0] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).select("__lang").collect()} == {"und"}


# --- mixing ---------------------------------------------------------------------------------


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        stop = {s for s in open_ if 2 * sizes[s] <= level * weight[s]}
        if not stop:
            target.update({s: level * weight[s] for s in open_})
            break
        for s in stop:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= stop
    return target


def test_mixing(docs, rows):
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    sizes = collections.Counter()
    for r, n in zip(rows, words):
        sizes[r[3]] += n
    target = brute_targets(dict(sizes))
    got = mixing.rated(docs).select("doc_id", "source", "__size", "__source_size", "__target", "__copies").collect()
    assert sorted(r["__size"] for r in got) == sorted(words)
    for r in got:
        assert r["__source_size"] == sizes[r.source]
        assert r["__target"] == pytest.approx(target[r.source], rel=1e-9)
        assert 0 <= r["__copies"] <= 2
        rate = target[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert r["__copies"] in (int(rate), int(rate) + (rate % 1 > 0))
    again = mixing.rated(docs.repartition(5)).select("doc_id", "__copies").collect()
    assert sorted(map(str, ((r.doc_id, r["__copies"]) for r in got))) == sorted(map(str, map(tuple, again)))
    assert mixing.mix(docs).count() == sum(r["__copies"] for r in got)
    assert mixing.mix(docs).columns == docs.columns


# --- suffix dedup ---------------------------------------------------------------------------


def test_suffix_dedup(docs, rows):
    got = collect(suffix_dedup.digest(suffix_dedup.dedup_substrings(docs)), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    expected = suffix_dedup.brute_force([(r[1] or "").encode() for r in rows])
    assert sorted(got) == sorted(expected)
    assert sum(r[1] for r in got) > 5000


@pytest.mark.parametrize("seed", range(3))
def test_suffix_dedup_of_periodic_and_edited_texts(spark, seed):
    import random

    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    a, b = word(1500), word(900)
    texts = [a, b, a[:700] + b[100:600] + a[900:], b[:399], b[:400], "x" * 1200, "xy" * 700, (word(60) + "\n") * 20, a[300:720] + word(30) + a[740:1160], word(2000)]
    for _ in range(12):
        t = list(a)
        for _ in range(rng.randint(1, 3)):
            t[rng.randrange(len(t))] = "#"
        texts.append("".join(t)[rng.randint(0, 200) :])
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = collect(suffix_dedup.digest(suffix_dedup.dedup_substrings(df)).orderBy("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == suffix_dedup.brute_force([t.encode() for t in texts])


def test_what_suffix_dedup_leaves_can_be_read(spark):
    """A shared passage of 400 bytes is gone from both texts; one of over 50 words below that, and other texts, stay."""
    passage, short = " ".join(f"passage{i:03d}" for i in range(60)), " ".join(f"w{i:04d}" for i in range(60))
    assert len(short) < 400 < len(passage)
    texts = ["first " + passage + "!", "the second: " + passage, "été " + short + "?", "hiver, " + short, "un été clair", None, "é" + "-" + passage, "©" + "-" + passage]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = suffix_dedup.digest(suffix_dedup.dedup_substrings(df)).orderBy("doc_id")
    assert got.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    left = ["first!", "the second:", *texts[2:5], "", "\ufffd", "\ufffd"]
    assert collect(got, "text", "n_chars") == [(t, len(t)) for t in left]
    assert collect(got, "n_bytes") == [(len((t or "").encode()),) for t in texts]


def test_long_texts_are_hashed_in_pieces():
    text = bytes((i * 7919 >> 3) % 251 for i in range(6000))
    one = [x.tolist() for x in suffix_dedup.anchors(text)]
    assert one == [x.tolist() for x in suffix_dedup.anchors(text, piece=700)]
    assert one[1][0] == 0 and one[2][-1] == len(text) - 400


def test_multikey_order():
    import numpy as np

    rng = np.random.default_rng(1)
    rows = rng.integers(97, 99, (300, 37)).astype(np.uint8)
    rows[100:200] = rows[:100]
    ordered = [rows[i].tobytes() for i in suffix_dedup.multikey_order(rows)]
    assert ordered == sorted(r.tobytes() for r in rows)


# --- packing and token counts ------------------------------------------------------------------


def reference_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_packing_round_trip(docs, rows):
    import numpy as np

    pieces = packing.pack(docs).select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset").collect()
    by_sequence = collections.defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length and p.length > 0
        by_sequence[p.sequence_id].append(p)
    stream = []
    for s in sorted(by_sequence):
        at = 0
        for p in sorted(by_sequence[s], key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
            stream += np.frombuffer(p.ids, "<u4").tolist()
        assert at == 1024 or s == max(by_sequence)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    found, one = [], []
    for v in stream:
        one.append(v)
        if v == 0:
            found.append(one)
            one = []
    expected = [ids + [0] for ids in reference_ids([r[1] or "" for r in rows])]
    if not any(0 in e[:-1] for e in expected):
        assert sorted(found) == sorted(expected)
    assert sum(p.length for p in pieces) == sum(map(len, expected))


def test_packing_matches_added_tokens(spark):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end}", f"one  {end}  two\n{end}", "<|endoftext", f"é{end[:-1]}{end}1", "plain  text "]
    pieces = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {p.doc_id: np.frombuffer(p.ids, "<u4").tolist() for p in pieces}
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert got == {i: e.ids + [0] for i, e in enumerate(plain.encode_batch(texts, add_special_tokens=False))}


def test_token_counts_keep_the_separator_as_text(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>"]
    got = token_scan.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(collect(got, "doc_id", "n_tokens")) == [(i, len(ids)) for i, ids in enumerate(reference_ids(texts))]


def test_token_counts(docs, rows):
    got = collections.Counter(collect(token_scan.token_counts(docs), "doc_id", "n_tokens"))
    assert got == collections.Counter((r[0], len(ids)) for r, ids in zip(rows, reference_ids([r[1] or "" for r in rows])))


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_token_files_of_any_block_size(spark, tmp_path, block):
    import random

    import numpy as np

    rng, expected = random.Random(block), []
    for f in range(3):
        ids, at = [], 0
        for k in range(rng.randint(1, 30)):
            n = rng.choice([0, 0, 1, 2, 5, 40])
            expected.append((f, k, at, n, True))
            ids += [rng.randint(0, 9) for _ in range(n)] + [99]
            at += n + 1
        if f == 1:
            ids += [1, 2, 3]
            expected.append((f, k + 1, at, 3, False))
        (tmp_path / f"{f}.bin").write_bytes(np.array(ids, "<u2").tobytes())
    (tmp_path / "empty.bin").write_bytes(b"")
    found = token_scan.stitch(token_scan.scan(token_scan.read_token_files(spark, str(tmp_path), block_tokens=block), end=99), run=4)
    got = [(int(re.search(r"(\d)\.bin", r.file)[1]), r.ordinal, r.start, r.n_tokens, r.closed) for r in found.collect()]
    assert sorted(got) == sorted(expected)


# --- empty tables ----------------------------------------------------------------------------


def test_empty_tables(none):
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.drop_near_duplicates(none).count() == 0
    assert exact_dedup.duplicate_groups(none).count() == 0
    assert exact_dedup.drop_exact_duplicates(none).count() == 0
    assert langid.identify(none).count() == 0
    assert mixing.rated(none).count() == 0
    assert suffix_dedup.dedup_substrings(none).count() == 0
    assert packing.pack(none).count() == 0
    assert token_scan.token_counts(none).count() == 0


# --- clashing names -------------------------------------------------------------------------

OWN = "__lang __letters __score __source __size __copies __copy __g __sha __first __mix __maybe __block __bits row key gone sha draw of rows first salt".split()


@pytest.fixture(scope="session")
def clashing(docs):
    """Every name that an operator uses for itself, and values that must come through."""
    at = docs
    for name in OWN:
        at = at.withColumn(name, F.lit(f"my {name}"))
    return at


@pytest.mark.parametrize("stage", [langid.in_a_language, exact_dedup.drop_exact_duplicates, simhash.drop_near_duplicates, mixing.mix])
def test_clashing_names_come_through(clashing, docs, stage):
    found, plain = stage(clashing), stage(docs)
    assert found.columns == clashing.columns
    rows = found.collect()
    assert all(r[name] == f"my {name}" for r in rows for name in OWN)
    assert sorted(str((r.doc_id, r.text)) for r in rows) == sorted(str(tuple(r)) for r in plain.select("doc_id", "text").collect())


def test_clashing_names_of_results(clashing, docs):
    assert langid.identify(clashing).columns[-2:] == ["__lang", "__score"] and mixing.rated(clashing).count() == docs.count()
    for operator in (simhash.near_duplicates, exact_dedup.duplicate_groups, packing.pack, token_scan.token_counts, suffix_dedup.dedup_substrings):
        assert operator(clashing.limit(20)).count() >= 20


def test_hot_key_of_a_lookup(spark):
    """Rows of a hot key are dealt to several tasks, and none is lost."""
    rows = spark.range(5000).select((F.col("id") % 5000 * F.when(F.col("id") < 3000, 0).otherwise(1)).alias("a"), F.col("id").alias("b"))
    found = rows.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    found.write.mode("overwrite").parquet(path := f"{common.shared_dir(spark)}/lookup")
    got = simhash.looked_up(rows, "a", spark.read.parquet(path))
    assert got.count() == 5000 and got.where("m != if(b < 3000, 0, b)").count() == 0


def test_a_repeated_row_and_a_group_of_copies_keep_one(spark):
    at = spark.createDataFrame([(7, "same row")] * 400 + [(i, "copy  of one text") for i in range(400)] + [(None, "no id")] * 30, "doc_id long, text string").repartition(7)
    assert sorted(map(str, map(tuple, exact_dedup.drop_exact_duplicates(at).collect()))) == sorted(map(str, [(7, "same row"), (0, "copy  of one text"), (None, "no id")]))


def test_a_very_long_text_and_many_empty_ones(spark):
    long = "".join(f"w{i % 977} " for i in range(300_000))
    at = spark.createDataFrame([(0, long)] + [(i, "") for i in range(1, 3000)], "doc_id long, text string")
    got = dict(collect(token_scan.token_counts(at), "doc_id", "n_tokens"))
    assert len(got) == 3000 and got[0] > 300_000 and not any(got[i] for i in range(1, 3000))
    assert sum(r.length for r in packing.pack(at).select("length").collect()) == got[0] + 3000
    assert simhash.near_duplicates(at).where("component_id = 1").count() == 2999
    assert exact_dedup.drop_exact_duplicates(at).count() == 2


def test_token_file_is_read_by_ranges(spark, tmp_path, monkeypatch):
    import numpy as np

    monkeypatch.setattr(token_scan, "TASK_BLOCKS", 3)
    ids = np.arange(5000, dtype="<u4") % 100 + 70_000
    (tmp_path / "a file.bin").write_bytes(ids.tobytes())
    blocks = token_scan.read_token_files(spark, str(tmp_path), id_bytes=4, block_tokens=64)
    assert blocks.rdd.getNumPartitions() > 20
    got = token_scan.stitch(token_scan.scan(blocks, end=70_099, id_bytes=4)).collect()
    assert sorted((r.ordinal, r.n_tokens, r.closed) for r in got) == [(i, 99, True) for i in range(50)]
