from pyspark.sql import functions as F

from kestrel.llm import common, jaccard, urlfilter


def judged(spark, urls, **more):
    rows = [(i, u, f"x{i}") for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string, template string")  # a clashing extra column
    return {r["page_id"]: r for r in urlfilter.filter_urls(df, **more).collect()}


def test_host_path_and_rules(spark):
    got = judged(spark, ["http://A.B.NET/x?y#z", "https://m.example.net/en/1", "http://example.com/de/2", "ftp://x.org/fr/3#t",
                         "http://x.org/fr", None, "no scheme", "http://a.net", "http://notexample.net?q=http://b/", "http://x/http://y/z", "://h#p/q"])
    want = [("a.b.net", "/x", "net/", "block"), ("m.example.net", "/en/1", "example.net/en/", "allow"), ("example.com", "/de/2", "example.com/de/", "block"),
            ("x.org", "/fr/3", "org/fr/", "allow"), ("x.org", "/fr", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.net", "", None, None),
            ("notexample.net", "", None, None), ("x", "/http://y/z", None, None), ("h", "", None, None)]
    for i, (host, path, rule, verdict) in enumerate(want):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), i
        assert verdict is None or got[i]["verdict"] == verdict


def test_tree_generalises_merges_and_rejects(spark):
    rules = (("block", "h.com", "/spam/1"), ("allow", "h.com", "/news/1"))
    urls = [f"http://h.com/spam/{n}" for n in range(10, 60)] + [f"http://h.com/news/{n}" for n in range(10, 60)]
    urls += ["http://h.com/spam/777", "http://h.com/news/888"] + [f"http://h.com/tag/w{n}x/p" for n in range(60)]
    got = judged(spark, urls, rules=rules)
    assert got[100]["verdict"] == "block" and got[100]["template"] == "/spam/{n}/"
    assert got[101]["verdict"] == "allow" and got[101]["purity"] < 0.5
    assert {got[i]["template"] for i in range(102, 162)} == {"/tag/*/p/"}


def test_empty_and_repeated(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert urlfilter.filter_urls(none).count() == 0
    df = spark.createDataFrame([(1, "http://q.net/a")] * 5 + [(None, "http://q.net/a")], "page_id long, url string")
    assert [r["verdict"] for r in urlfilter.filter_urls(df).collect()] == ["block"] * 6


def test_only_the_url_and_key_are_read_and_no_python(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    out = urlfilter.filter_urls(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan and "Python" not in plan and "Arrow" not in plan
    assert F is not None


def test_hot_and_other_keys_join_alike(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    seen = []
    for share in (1024, 4, 1):  # all keys broadcast, a few, at most one
        monkeypatch.setattr(common, "HOT", share)
        monkeypatch.setattr(urlfilter, "HOT", share)
        seen.append((sorted(map(tuple, urlfilter.op1(pages).collect()), key=str), sorted(map(tuple, jaccard.op2(docs).collect()), key=str)))
    assert seen[0] == seen[1] == seen[2] and len(seen[0][0]) and len(seen[0][1])
