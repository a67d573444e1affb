import collections
import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from cadenza.llm import fingerprints as fp
from cadenza.llm.queries import op3_fingerprints


def bag(text):
    return collections.Counter(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def jaccard(a, b):
    keys = set(a) | set(b)
    most = sum(max(a[k], b[k]) for k in keys)
    return sum(min(a[k], b[k]) for k in keys) / most if most else 1.0


def shares(spark, pairs):
    """The mean share of common draws over pairs of texts."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(t for p in pairs for t in p)], "doc_id long, text string")
    found = {r.doc_id: re.findall("....", r.fingerprint) for r in fp.fingerprint(docs).collect()}
    return [np.mean([a == b for a, b in zip(found[2 * i], found[2 * i + 1], strict=True)]) for i in range(len(pairs))]


def test_ratios_of_weights(spark):
    """One word, once against n times: draws agree in 1 / n of all cases."""
    ratios, n = (2, 3, 10), 1000
    pairs = [(f"w{n}x{i}", " ".join([f"w{n}x{i}"] * n)) for n in ratios for i in range(1000)]
    got = np.array(shares(spark, pairs)).reshape(len(ratios), n).mean(axis=1)
    assert np.abs(got - 1 / np.array(ratios)).max() < 0.01


def test_large_bags(spark):
    """Hundreds of words of mixed weights, where the lower tail of c decides."""
    rng = np.random.default_rng(1)
    pairs = []
    for i in range(150):
        a = rng.integers(1, 12, 400)
        b = np.where(rng.random(400) < 0.5, a, rng.integers(0, 40, 400))
        pairs.append(tuple(" ".join(f"p{i}w{j}" for j in range(400) for _ in range(x[j])) for x in (a, b)))
    error = np.array(shares(spark, pairs)) - [jaccard(bag(a), bag(b)) for a, b in pairs]
    assert abs(error.mean()) < 0.01


def test_whole_table(spark, sf_dir):
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda r: -r.doc_id)
    got = {r.doc_id: r for r in op3_fingerprints(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    errors, by_text = [], {}
    for i, d in enumerate(docs):
        after = docs[(i + 1) % len(docs)].text
        half = len(d.text) // 2
        edited = d.text[: len(d.text) - half] + after[:half]
        r = got[d.doc_id]
        assert r.n_chars == len(d.text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(d.text, r.fingerprint) == r.fingerprint
        assert by_text.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        errors.append((r.near_edited - jaccard(bag(d.text), bag(edited)), r.near_next - jaccard(bag(d.text), bag(after))))
    error = np.array(errors)
    assert np.abs(error.mean(axis=0)).max() < 0.02
    assert np.sqrt((error**2).mean(axis=0)).max() < 1.3 * 0.5 / np.sqrt(fp.SAMPLES)


def test_likeness_of_weights(spark):
    """Weights count, not only words: pairs of bags, each pair with a vocabulary of its own."""
    rng = np.random.default_rng(0)
    texts = []
    for n in range(400):
        texts.append(" ".join(f"p{n // 2}w{i}" for i in range(12) for _ in range(int(rng.integers(0, 9)))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: re.findall("....", r.fingerprint) for r in fp.fingerprint(docs).collect()}
    error = []
    for i in range(0, 400, 2):
        same = np.mean([a == b for a, b in zip(found[i], found[i + 1], strict=True)])
        error.append(same - jaccard(bag(texts[i]), bag(texts[i + 1])))
    assert abs(np.mean(error)) < 0.01


def test_order_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 2)
    rows = [(5, "a b c d"), (9, "e f g h i"), (None, "null id"), (3, None), (5, "a b c d"), (5, "other"), (-7, "x"), (2**40, "long " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("range", F.lit("clash")).repartition(3)
    got = fp.fingerprint_edits(docs).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_chars): r for r in got}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    fives = sorted([r.edited_sha256 for r in got if r.doc_id == 5])
    assert by[(-7, 1)].edited_sha256 == sha("x")
    assert by[(2**40, 150_000)].edited_sha256 == sha(("long " * 30_000)[:75_000] + "e f g h i")
    assert by[(9, 9)].edited_sha256 in (sha("e f g" + "a b "), sha("e f g" + "othe"))
    assert by[(None, 7)].edited_sha256 == sha("null" + "lon")
    assert by[(3, 0)].edited_sha256 == sha("") and by[(3, 0)].near_next == 0 and by[(3, 0)].near_edited == 1
    assert len(fives) == 3
    assert fp.fingerprint_edits(docs.limit(0)).count() == 0
    alone = fp.fingerprint_edits(docs.where("doc_id = -7")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1
