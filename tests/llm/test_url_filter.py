from loomgraph.llm import bloom
from loomgraph.llm.url_filter import judge, rules_frame

from pyspark.sql import functions as F


def brute(url, rules, listed):
    def parts(u):
        if not u or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:cut], rest[cut:]
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]

    host, path = parts(url)
    fits = [(len(h) + len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if host and (host, path) in {parts(u) for u in listed} else "allow"


URLS = ["http://a.example.com/en/x?q", "https://www.EXAMPLE.com/en/", "http://example.com/fr/", "http://x.net/es/1", "http://x.net/de/", "ftp://net/fr/a#b", "nothing", "", None, "http://", "http://é.net/es/", "http://com", "http://notexample.com/en/", "http://x.org/dead?p=1", "http://x.org/dead", "http://" + "a" * 5000 + ".com/" + "b" * 9000, "http://x.net/es/1"]


def test_against_brute_force(spark):
    rules = [(r["host"], r["path"], r["verdict"]) for r in rules_frame(spark).collect()]
    pages = spark.createDataFrame([(i if i != 3 else None, u, "old", "keep", 1, 2, 3, 4, 5, 6) for i, u in enumerate(URLS)], "page_id long, url string, verdict string, _key2 string, _best int, best int, row int, _key int, _block int, _w0 int")
    listed = ["http://x.org/dead#x", None, "bad"]
    got = judge(pages, rules_frame(spark), spark.createDataFrame([(u,) for u in listed], "url string"))
    assert sorted(got.columns) == sorted(["page_id", "url", "_key2", "_best", "best", "row", "_key", "_block", "_w0", "host", "path", "rule", "verdict"])
    rows = got.collect()
    assert len(rows) == len(URLS)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == brute(r.url, rules, listed)


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert judge(none, rules_frame(spark), none.select("url")).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/es/")], "page_id long, url string")
    assert judge(one, rules_frame(spark).limit(0), none.select("url")).first().verdict == "allow"


def test_filter_loses_nothing_and_rejects_most(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("k"))
    table, blocks = bloom.build(keys, "k")
    assert bloom.possible(keys, F.col("k"), table, blocks).count() == 5000
    others = spark.range(5000).select(F.concat(F.lit("other"), "id").alias("k"))
    assert bloom.possible(others, F.col("k"), table, blocks).count() < 250
    full, one = bloom.build(keys, "k", max_blocks=1)
    assert bloom.possible(keys, F.col("k"), full, one).count() == 5000
