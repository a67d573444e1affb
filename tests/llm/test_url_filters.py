import datetime as dt

from pyspark.sql import functions as F

from cadenza.llm import url_filters as uf


def day(s):
    return dt.date.fromisoformat(s)


def test_active_entries(spark):
    log = [
        ("l", "domain", "bad.org", "2024-01-10", "add"),
        ("l", "domain", "bad.org", "2024-01-12", "add"),
        ("l", "domain", "bad.org", "2024-02-01", "remove"),
        ("l", "domain", "BAD.org", "2024-03-01", "add"),
        ("m", "host", "www.bad.org", "2024-01-20", "add"),
        ("p", "path", "ok.com/a/b", "2024-01-01", "add"),
        ("p", "path", "ok.com/same", "2024-01-05", "add"),
        ("p", "path", "ok.com/same", "2024-01-05", "remove"),
        ("x", None, "ok.com", "2024-01-01", "add"),
        ("x", "host", "ok.com", None, "add"),
    ]
    rows = [
        (1, "http://www.bad.org/x", "2024-01-09"),
        (2, "https://User@WWW.Bad.org.:80/x?y#z", "2024-01-25"),
        (3, "http://sub.www.bad.org", "2024-02-01"),
        (4, "http://bad.org/", "2024-03-01"),
        (5, "http://notbad.org/", "2024-01-15"),
        (6, "http://ok.com/a/b/c", "2024-01-15"),
        (7, "http://ok.com/a/bc", "2024-01-15"),
        (8, "http://ok.com/same", "2024-01-15"),
        (9, None, "2024-01-15"),
        (10, "http://bad.org/", None),
        (11, "no url", "2024-01-15"),
        (4, "http://bad.org/", "2024-03-01"),
    ]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched string").withColumn("key", F.lit("clash")).withColumn("since", F.lit(1))
    got = uf.evaluate(captures, uf.entries(spark, tuple(log))).collect()
    assert len(got) == len(rows)
    blocked = sorted((r.page_id, r.n_entries, r.lists, r.first_since) for r in got if r.blocked)
    assert blocked == [(2, 2, "l,m", day("2024-01-10")), (4, 1, "l", day("2024-03-01")), (4, 1, "l", day("2024-03-01")), (6, 1, "p", day("2024-01-01"))]
    assert all(r.n_entries == 0 and r.lists == "" for r in got if not r.blocked)


def test_shuffled_lists_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(uf, "BROADCAST_ROWS", 0)
    captures = spark.createDataFrame([(1, "http://spam-farm.example.org/a", "2024-05-01")], "page_id long, url string, fetched string")
    assert uf.evaluate(captures, uf.entries(spark)).first().blocked
    assert uf.evaluate(captures.limit(0), uf.entries(spark)).count() == 0
    assert not uf.evaluate(captures, uf.entries(spark).limit(0)).first().blocked


def test_intervals(spark):
    rows = uf.intervals(uf.entries(spark)).where("key = 'cheap-pills.example.com'").orderBy("since").collect()
    assert [(r.since, r.until) for r in rows] == [(day("2024-03-01"), day("2024-09-01")), (day("2024-11-01"), None)]
