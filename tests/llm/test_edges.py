"""Nulls, repeated rows, clashing columns and very long inputs, where the operators' own tests don't have them."""

import collections
import math
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cadenza.llm import quality_classifier, token_counts, url_filters
from cadenza.llm.packing import pack
from tests.llm.test_tokens import check_packing, ids

PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG = "the quick brown fox, 12 times; " * 40_000


def test_token_counts_of_odd_rows(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "two words"), (None, "two words"), (3, LONG)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash")).withColumn("n_bytes", F.lit(None).cast("int"))
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, PATH).collect())
    want = collections.Counter((d, len((t or "").encode()), len(ids(t or "")), len(ids(t or "")) > 1024) for d, t in rows)
    assert got == want


def test_packing_of_a_long_text(spark):
    docs = spark.createDataFrame([(1, LONG), (2, "short"), (2, "short")], "doc_id long, text string").withColumn("offset", F.lit("clash"))
    check_packing(pack(spark, docs, PATH).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_filters_of_a_long_url(spark):
    path = "/" + "/".join(f"p{i}" for i in range(400))
    pages = spark.createDataFrame([(1, "http://a.example.com" + path + "?" + "q" * 100_000), (2, "http://" + "x." * 100 + "example.org/")], "page_id long, url string")
    pages = pages.withColumn("fetched", F.lit("2024-05-01").cast("date"))
    import datetime

    entries = spark.createDataFrame([("l", "path", "a.example.com" + path[: path.index("/p200")], datetime.date(2024, 1, 1), "add")], url_filters.ENTRY_SCHEMA)
    assert sorted((r.page_id, r.blocked) for r in url_filters.evaluate(pages, entries).collect()) == [(1, True), (2, False)]


def plain_statistics(text):
    """The statistics of a text in plain Python."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count, covered = collections.Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered.update(range(i, i + 8))
    n, chars, n_lines = max(len(w), 1), max(sum(map(len, w)), 1), max(len(lines), 1)
    import unicodedata

    kind = collections.Counter(map(unicodedata.category, text))
    return {
        "words": math.log(1 + len(w)),
        "word_length": sum(map(len, w)) / n,
        "symbols": len(re.findall(r"[#*$%&|<>]", text)) / n,
        "repeats": len(covered) / n,
        "dup_lines": (len(lines) - len(set(lines))) / n_lines,
        "line_words": math.log(1 + len(w) / n_lines),
        "distinct": len(set(w)) / n,
        "distinct_root": len(set(w)) / math.sqrt(n),
        "upper": kind["Lu"] / chars,
        "marks": len(re.findall(r"[!?]", text)) / n,
        "digits": kind["Nd"] / chars,
        "stops": len(re.findall(r"\.(?=[\x20\x09-\x0D]|\Z)", text)) / n,
        "short": sum(len(x) <= 3 for x in w) / n,
    }


def test_statistics_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "A.\nA.\n\nB! ٣ Ⅷ é."), (-4, LONG)], "doc_id long, text string")
    both = docs.unionByName(odd)
    texts = {r.doc_id: r.text for r in both.collect()}
    rows = quality_classifier.statistics(both).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_statistics(texts[r.doc_id])
        assert {k: r[k] for k in want} == pytest.approx(want, rel=1e-9), r.doc_id


def test_pipeline_keeps_other_columns(spark, tmp_path):
    """Clashing names, a very long text, equal rows and nulls, through every stage."""
    good = " ".join(f"word{i}" for i in range(60))
    long_ = " ".join(f"long{i}" for i in range(60_000))
    rows = [(1, good, "en", "s", 1), (1, good, "en", "s", 1), (None, None, None, None, None), (5, long_, None, "s", 2), (None, " ".join(f"null{i}" for i in range(50)), "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("textid", "size", "plan", "order", "empty", "copies", "spans", "leader", "uid"):
        docs = docs.withColumn(name, F.lit(f"{name} of the table"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
    kept = {r.doc_id for r in now.collect()}
    assert kept <= {1, 5, None} and {r.plan for r in now.collect()} <= {"plan of the table"}
    rows = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in now.collect()])


def test_runs_leave_each_others_tables(spark, tmp_path):
    """Two runs side by side: a stage of one doesn't delete what the other still reads."""
    good = [(i, " ".join(f"w{i}x{j}" for j in range(60)), "en", "s", 1) for i in range(5)]
    frames = {}
    for run in ("a", "b"):
        spark.createDataFrame(good, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/{run}/documents.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{run}/documents.parquet")
        corpus_pipeline.STAGES[0][1](spark, docs, f"{tmp_path}/{run}")
        frames[run] = corpus_pipeline.STAGES[1][1](spark, docs, f"{tmp_path}/{run}")
    corpus_pipeline.STAGES[2][1](spark, docs, f"{tmp_path}/b")
    assert frames["a"].count() == 5
