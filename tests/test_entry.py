import sys

import __spark_entry__
from cadenza.plans.oracles import SQL
from cadenza.plans.queries import QUERIES


def test_the_rest_works_without_the_corpus_part(monkeypatch):
    """Whether the folders are gone or something that they need is missing."""
    monkeypatch.setitem(sys.modules, "cadenza.llm.queries", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(__spark_entry__.queries()) == set(QUERIES)
    assert __spark_entry__.oracle_sql() == SQL and set(SQL) <= set(QUERIES)


def test_caps_are_only_in_queries_that_say_so():
    assert all("LIMIT 1000" not in SQL[n] for n in SQL if n.endswith(("_whole", "_texts")))
    assert all(f"{n}_whole" in SQL for n in ("holdout_split", "cooccurrence_counts", "cf_scores_topk", "metrics_by_variant"))
