"""The pipeline against a brute-force version, stage after stage."""

import collections
import hashlib

import corpus_pipeline
import numpy as np
import __spark_entry__ as entry

from .test_documents import brute_components, brute_fingerprint, brute_targets, normal, reference_ids


def words(text):
    return len([w for w in normal(text).split(" ") if w])


def brute_pipeline(rows):
    """(doc_id, ids with the end id) of each document copy that is packed."""
    docs = [(r[0], r[1], r[3]) for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    first = {}
    for d in docs:
        t = normal(d[1])
        if t not in first or first[t][0] is None or d[0] is not None and d[0] < first[t][0]:
            first[t] = d
    docs = list(first.values())
    root = brute_components({brute_fingerprint(d[1]) for d in docs})
    least = {}
    for d in docs:
        if d[0] is not None:
            k = root[brute_fingerprint(d[1])]
            least[k] = min(d[0], least.get(k, d[0]))
    docs = [d for d in docs if d[0] is None or least[root[brute_fingerprint(d[1])]] == d[0]]
    sizes = collections.Counter()
    for d in docs:
        sizes[d[2]] += words(d[1])
    target = brute_targets(dict(sizes))
    out = []
    for i, t, s in docs:
        rate = target[s] / sizes[s] if sizes[s] else 0.0
        draw = int(hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        out += [(i, t)] * (int(rate) + (draw < rate - int(rate)))
    return [(i, tuple(ids + [0])) for (i, _), ids in zip(out, reference_ids([t for _, t in out]))]


def test_pipeline(spark, docs, rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "ids", "sequence_id", "offset").collect()
    found, ids = [], []
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        ids += np.frombuffer(p.ids, "<u4").tolist()
        if ids[-1] == 0:
            found.append((p.doc_id, tuple(ids)))
            ids = []
    assert sorted(found, key=str) == sorted(brute_pipeline(rows), key=str)


def test_stages_keep_the_columns(spark, docs):
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, "")
        assert at.columns == docs.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash", "mixing", "packing"]


def test_every_operator_is_registered():
    found = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in found) for i in range(1, 11)) and "pipeline" in found
