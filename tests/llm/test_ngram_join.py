import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import ngram_join
from cadenza.llm.common import HUB_ROWS, Scratch
from cadenza.llm.components import components
from cadenza.llm.queries import op6_ngram_join


def shingles(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, num, den):
    """(doc_id, size, component) of every row, by comparing all pairs."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in op6_ngram_join(spark, sf_dir).collect())
    assert got == brute(rows, 4, 85, 100)


def family(rng, n, words, edits):
    base = [f"w{rng.randrange(40)}" for _ in range(words)]
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(len(own))] = f"e{rng.randrange(10_000)}"
        yield " ".join(own)


@pytest.mark.parametrize("k,num,den,block", [(4, 85, 100, 4096), (5, 80, 100, 16), (2, 50, 100, 8)])
def test_families(spark, monkeypatch, k, num, den, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(k)
    texts = [t for w in (3, 9, 30, 60, 200) for _ in range(3) for t in family(rng, 12, w, 1 + w // 12)]
    texts += ["", " \n", "One", "one", "one two three", "ONE two  three", "é", "É", *(" ".join(f"p{i}" for i in range(60)) + f" own{j} a b c" for j in range(20))]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(6, texts[2]), (6, texts[2]), (9, texts[40])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).repartition(5)
    got = ngram_join.near_duplicates(docs, k, num, den)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows, k, num, den)


def test_nulls_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (2, None), (3, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id, r.leader) for r in ngram_join.near_duplicates(docs, 4, 85, 100).collect()}
    assert got == {(None, 3, 3, False), (2, 0, 2, True), (3, 3, 3, True), (None, 0, None, True)}
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0


def test_search_finds_what_all_pairs_find():
    rng = np.random.default_rng(3)
    for trial in range(60):
        base = rng.choice(400, size=(4, 60), replace=True).astype(np.uint64)
        sets = []
        for _ in range(40):
            s = base[rng.integers(4)].copy()
            hit = rng.random(len(s)) < rng.random() * 0.25
            s[hit] = rng.integers(1000, 2000, hit.sum())
            sets.append(np.unique(s[: rng.integers(2, 61)]))
        root = list(range(len(sets)))

        def find(i, root):
            while root[i] != i:
                i = root[i]
            return i

        want, got = list(root), list(root)
        for i in range(len(sets)):
            for j in range(i):
                inter = len(np.intersect1d(sets[i], sets[j]))
                if 10 * inter >= 7 * (len(sets[i]) + len(sets[j]) - inter):
                    want[find(i, want)] = find(j, want)
        for i, j in ngram_join.search(sets, 7, 10):
            got[find(i, got)] = find(j, got)
        group = lambda r: {frozenset(i for i in range(len(r)) if find(i, r) == find(j, r)) for j in range(len(r))}
        assert group(want) == group(got), trial


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"))
    assert {(r.node, r.root) for r in got.collect()} == {(i, find(i)) for i in list(root)}


@pytest.mark.parametrize("least", [1, 3, 8])
def test_heap_and_counting_agree(monkeypatch, least):
    rng = np.random.default_rng(least)
    for _ in range(30):
        lists = [np.unique(rng.integers(0, 60, rng.integers(1, 40))) for _ in range(rng.integers(1, 12))]
        got = []
        for limit in (10**9, 0):
            monkeypatch.setattr(ngram_join, "HEAPED", limit)
            got.append([x.tolist() for x in ngram_join.merge(lists, least)])
        assert got[0] == got[1]


def test_full_ranges_are_counted_by_rows(spark, monkeypatch):
    """Shingles of every document fill their ranges."""
    rng = random.Random(5)
    common = [rng.randrange(1 << 64) for _ in range(3)]
    sets = [sorted({*common, *(rng.randrange(1 << 64) for _ in range(4)), rng.choice(common) ^ rng.randrange(3)}) for _ in range(600)]
    df = spark.createDataFrame([(i, np.array(s, "<u8").tobytes()) for i, s in enumerate(sets)], "uid long, shingles binary")
    total = sum(map(len, sets))
    want = ngram_join.shared_shingles(df, total)
    rows = sorted(map(tuple, want.collect()))
    monkeypatch.setattr(ngram_join, "BUCKET", 64)
    assert sorted(map(tuple, ngram_join.shared_shingles(df, total).collect())) == rows
    counts = {}
    for s in sets:
        for x in s:
            counts[x] = counts.get(x, 0) + 1
    assert len(rows) == sum(n for n in counts.values() if n > 1)


def test_long_text_and_large_family(spark, monkeypatch):
    """A family of several blocks, each member near to some others only; a text of a million words."""
    monkeypatch.setattr(ngram_join, "BLOCK", 24)
    rng = random.Random(9)
    rows = list(enumerate(family(rng, 150, 80, 5)))
    rows += [(1000 + i, t) for i, t in enumerate(family(rng, 60, 40, 9))] + [(2000, "long text " * 500_000), (2001, "Long  text " * 500_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = ngram_join.near_duplicates(docs, 4, 85, 100)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows, 4, 85, 100)


def test_joins_that_grow_are_not_broadcast(spark, monkeypatch):
    """Spark takes rows that were exploded to pairs of blocks for few, and sent all of them to the driver."""
    monkeypatch.setattr(ngram_join, "BLOCK", 24)
    plans = []
    write = Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(self, df))
    rng = random.Random(4)
    tail = " ".join(f"s{i}" for i in range(12))
    rows = [(i, " ".join(f"u{i}x{j}" for j in range(30)) + " " + tail) for i in range(120)] + [(500 + i, t + " " + tail) for i, t in enumerate(family(rng, 40, 60, 3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = ngram_join.near_duplicates(docs, 4, 85, 100)
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows, 4, 85, 100)
    # the only broadcasts are those of frequent keys, which HUBS bounds
    for lines in map(str.splitlines, plans):
        assert [x for i, x in enumerate(lines) if "BroadcastExchange" in x and f"> {HUB_ROWS})" not in "".join(lines[i : i + 4])] == []
    assert any("explode" in p and "FlatMapGroupsInArrow" in p for p in plans)


def test_unlinked_cluster_takes_work_in_proportion(spark, monkeypatch):
    """A chain of documents, each with a rare shingle of the next: only those that share one are searched together."""
    monkeypatch.setattr(ngram_join, "BLOCK", 24)
    n, searched = 240, []
    words = {i: " ".join(f"w{i}x{j}" for j in range(30)) for i in range(n)}
    words[101] = words[100] + " more"
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).coalesce(2)
    groups = frame([(i, 0, len(t), i) for i, t in words.items()], "uid long, root long, chars long, group long")
    texts = frame(list(words.items()), "uid long, text string")
    prefix = frame([(i, s) for i in range(n) for s in (i, i + 1)], "uid long, shingle long")
    clusters = ngram_join.Clusters(Scratch(spark, "t"), groups.drop("group"), texts, prefix, 4, 85, 100)
    search = clusters.search
    clusters.search = lambda rows, *keys: searched.append(rows.count()) or search(rows, *keys)
    assert [tuple(r) for r in clusters.rest(groups).distinct().collect()] in ([(100, 101)], [(101, 100)])
    assert sum(searched) <= 2 * n
