import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import suffix_dedup
from cadenza.llm.queries import op4_suffix_dedup


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, sha256) of each text."""
    raws = [(t or "").encode() for t in texts]
    count = collections.Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[: len(r)]
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        spans = int(np.sum(np.diff(np.r_[0, gone.astype(int)]) == 1))
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_array():
    rng = np.random.default_rng(0)
    for trial in range(60):
        n = int(rng.integers(0, 400))
        text = rng.integers(0, int(rng.integers(1, 6)), n).astype(np.uint8)
        depth = int(rng.integers(5, 60))
        order, _, _ = suffix_dedup.suffix_array(text, depth)
        assert sorted(order.tolist()) == list(range(n))
        raw = text.tobytes()
        firsts = [raw[i : i + depth] for i in order]
        assert [f.ljust(depth, b"\0") for f in firsts] == sorted(f.ljust(depth, b"\0") for f in firsts), trial


def test_repeated_windows():
    rng = random.Random(0)
    for _ in range(40):
        parts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(0, 40))) for _ in range(8)]
        length = rng.choice([5, 6, 11])
        count = collections.Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
        got = suffix_dedup.repeated_windows(parts, length)
        for p, hit in zip(parts, got, strict=True):
            assert hit.tolist() == [count[p[i : i + length]] > 1 for i in range(len(p) - length + 1)]


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    rows = op4_suffix_dedup(spark, sf_dir).collect()
    want = sorted((d.doc_id, *w) for d, w in zip(docs, brute([d.text for d in docs], 200), strict=True))
    assert sorted(tuple(r) for r in rows) == want
    assert sum(r.n_removed for r in rows) > 0


@pytest.mark.parametrize("dealt", [2048, 3])
def test_passages(spark, monkeypatch, dealt):
    """Passages between texts of their own, copies, repeats in one document, equal rows, and edges that differ."""
    monkeypatch.setattr(suffix_dedup, "DEALT", dealt)
    rng = random.Random(5)
    word = lambda k: "".join(rng.choice("abcdé\0") for _ in range(k))
    passages = [word(rng.randrange(20, 90)) for _ in range(4)]
    texts = [word(rng.randrange(40)) + rng.choice(passages)[rng.randrange(5) :] + word(rng.randrange(40)) + rng.choice(passages) for _ in range(40)]
    texts += [texts[0], texts[0], "x" * 500, "", None, "xy" * 30, "short", "long " * 20_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3]), (None, texts[4]), (None, "null id, unlike the others")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("uid", F.lit(1)).withColumn("spans", F.lit("clash")).repartition(4)
    got = suffix_dedup.remove_repeats(docs, length=24, gram=7).select("doc_id", "removal.*").collect()
    want = [(-1 if i is None else i, *w) for (i, _), w in zip(rows, brute([t for _, t in rows], 24), strict=True)]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(docs).count() == 0


def test_two_stages_and_common_prefixes():
    """Only suffixes that are smaller than their successors are sorted directly; neighbours' common prefixes."""
    rng = np.random.default_rng(4)
    for trial in range(60):
        n = int(rng.integers(1, 300))
        text = rng.integers(0, int(rng.integers(1, 5)), n).astype(np.uint8)
        if trial % 3 == 0:
            text = np.tile(text[: n // 4 + 1], 4)[:n]
        depth = int(rng.integers(5, 40))
        order, common, direct = suffix_dedup.suffix_array(text, depth)
        raw = text.tobytes()
        assert sorted(direct.tolist()) == [i for i in range(n - 1) if raw[i:] < raw[i + 1 :]]
        padded = raw + b"\0" * depth

        def shared(a, b):
            return next((k for k in range(depth) if padded[a + k : a + k + 1] != padded[b + k : b + k + 1]), depth)

        assert common.tolist() == [shared(a, b) for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True)]


def test_repeated_windows_of_long_repeats():
    rng = np.random.default_rng(5)
    for _ in range(20):
        base = rng.integers(97, 100, 400, dtype=np.uint8).tobytes()
        parts = [base[rng.integers(0, 100) : rng.integers(250, 400)] + rng.integers(97, 100, int(rng.integers(0, 60)), dtype=np.uint8).tobytes() for _ in range(6)]
        count = collections.Counter(p[i : i + 200] for p in parts for i in range(len(p) - 199))
        for p, hit in zip(parts, suffix_dedup.repeated_windows(parts, 200), strict=True):
            assert hit.tolist() == [count[p[i : i + 200]] > 1 for i in range(len(p) - 199)]
