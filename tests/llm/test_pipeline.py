"""The pipeline, stage by stage, against plain Python on the whole smallest table."""

import collections

import corpus_pipeline
from cadenza.llm import mixing
from tests.llm.test_ngram_join import brute as linked
from tests.llm.test_quality_rules import judge
from tests.llm.test_tokens import check_packing


def removed(texts, length=200):
    """The texts without repeated bytes."""
    raws = [t.encode() for t in texts]
    count = collections.Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = set()
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone.update(range(i, i + length))
        out.append(bytes(b for i, b in enumerate(r) if i not in gone).decode("utf-8", "ignore"))
    return out


def test_stages(spark, sf_dir, tmp_path):
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs, results = source, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        results.append(docs)
    assert all(r.columns == source.columns for r in results[:-1])
    rows = {r.doc_id: r for r in source.collect()}
    good = sorted(i for i, r in rows.items() if judge(r.text)["kept"])
    assert sorted(r.doc_id for r in results[0].collect()) == good
    groups = linked([(i, rows[i].text) for i in good], 5, 80, 100)
    leaders = sorted({c for _, n, c in groups if n} | {d for d, n, _ in groups if not n})
    assert sorted(r.doc_id for r in results[1].collect()) == leaders
    texts = dict(zip(leaders, removed([rows[i].text for i in leaders]), strict=True))
    touched = {i for i in leaders if texts[i] != rows[i].text}
    want = {i: t for i, t in texts.items() if i not in touched or t.strip()}
    assert {r.doc_id: r.text for r in results[2].collect()} == want
    assert all(r.n_chars == len(r.text) for r in results[2].collect())
    taken = collections.Counter(r.doc_id for r in results[3].collect())
    assert set(taken) <= set(want) and max(taken.values()) <= 2
    sizes, got = collections.Counter(), collections.Counter()
    for i, t in want.items():
        sizes[rows[i].source] += len(t.split())
        got[rows[i].source] += taken[i] * len(t.split())
    names = sorted(sizes)
    goal = mixing.targets([sizes[s] for s in names], [(3, 1, 2)[k % 3] for k in range(len(names))], 1.5, 2)
    for s, g in zip(names, goal, strict=True):
        assert abs(got[s] - g) <= max(len(t.split()) for i, t in want.items() if rows[i].source == s) / 2 + 1
    check_packing(results[4].collect(), [(r.doc_id, r.text) for r in results[3].collect()])


def test_run_and_odd_rows(spark, tmp_path):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(1, good, "en", "s", 1), (1, good, "en", "s", 1), (2, None, None, None, None), (3, good + " x", "en", None, 1), (4, " ".join(f"other{i}" for i in range(40)), None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/a/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    assert {r.doc_id for r in got} <= {1, 4} and got
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


def test_stages_are_named():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
