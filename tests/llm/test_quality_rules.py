import collections
import re

from pyspark.sql import functions as F

from cadenza.llm import quality_rules as qr


def judge(text):
    """The measurements and verdicts of a text, in plain Python."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(n - 7)]
    count = collections.Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    m = {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}
    failed = [n < 20, 100 * len(covered) > 30 * n, 10 * m["n_symbols"] > 3 * n, 10 * m["n_dup_lines"] > 3 * len(lines), m["word_chars"] < 2 * n, m["word_chars"] > 20 * n]
    return m | {"base_failed": failed[0] or failed[1], "kept": not any(failed), "failed_bits": sum(1 << i for i, f in enumerate(failed) if f)}


TEXTS = [None, "", " \n\t", "a " * 30, "one two three", "x y z a b c d e f " * 6, "\n".join(["same line here"] * 9), "$$$ ### " * 20, "ab " * 200_000, " ".join(f"w{i}" for i in range(50)), "é　b\x0bc\x1cd " * 10]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, "a b"), (4, TEXTS[4])], "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    rows = qr.quality_report(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        if r.doc_id is not None:
            want = judge(TEXTS[r.doc_id])
            assert {k: r[k] for k in want} == want
    assert qr.quality_report(docs.limit(0)).count() == 0
    assert qr.apply_policy(qr.ledger(docs), qr.POLICIES[0]).where("kept").count() == sum(not judge(t)["base_failed"] for t in TEXTS)


def test_ablation(spark, sf_dir):
    led = qr.ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")).persist()
    bits = [r.failed_bits for r in led.collect()]
    for r in qr.ablation(led, qr.POLICIES[-1]).collect():
        bit = 1 << next(x.bit for x in qr.RULES if x.name == r.rule)
        assert r.n_failed == sum(b & bit != 0 for b in bits)
        assert r.n_failed_only == sum(b == bit for b in bits)
        assert r.n_kept_without == sum(b & ~bit == 0 for b in bits)
