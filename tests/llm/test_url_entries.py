from cadenza.llm import url_filters as uf


def test_entries_are_normalised_like_urls(spark):
    log = [
        ("a", "path", "Host.org/En/Blog", "2024-01-01", "add"),
        ("b", "path", "host.org./En/Blog//", "2024-01-01", "add"),
        ("c", "domain", "Host.ORG./", "2024-01-01", "add"),
        ("d", "host", " host.org/ ", "2024-01-01", "add"),
        ("e", "path", "host.org/en/blog", "2024-01-01", "add"),
        ("f", "domain", "/", "2024-01-01", "add"),
        ("g", "path", "host.org/En/Blog/", "2024-01-01", "add"),
        ("g", "path", "HOST.org/En/Blog", "2024-02-01", "remove"),
    ]
    rows = [(1, "http://HOST.org/En/Blog/x", "2024-01-15"), (2, "http://host.org/en/blog", "2024-01-15"), (3, "http://host.org/En/Blog", "2024-03-01"), (4, "http://other.org/", "2024-01-15")]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched string")
    got = {r.page_id: r.lists for r in uf.evaluate(captures, uf.entries(spark, tuple(log))).collect()}
    assert got == {1: "a,b,c,d,g", 2: "c,d,e", 3: "a,b,c,d", 4: ""}
