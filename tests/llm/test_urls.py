import re

from pyspark.sql import functions as F

from quern.llm import urls
from quern.llm.queries import URL_RULES


def brute(url, listed):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits) if fits else None
    return host, path, rule and rule[1], rule[2] if rule else "block" if listed else "allow"


URLS = [
    "http://example.com/en/1", "https://WWW.Example.com/en/x", "http://a.www.example.com/en/", "http://com/", "http://com", "http://xcom/",
    "http://a.net/es/1", "http://a.net/ess", "https://net/fr/", "http://notexample.com/en/", "ftp://x.org?u=a://b/c", "http://x.org#://y", "no scheme", "", None,
    "://", "http:///p", "http://É.org/Ü?b=2&a=1&utm_source=x#f", "http://x.org/a\nb/c", "http://x.org/" + "a/" * 20_000, "a://b://c/d",
]


def test_verdicts(spark):
    rows = [(i, u, "h", "p") for i, u in enumerate(URLS)] + [(None, URLS[10], "h", "p"), (7, URLS[7], "h", "p")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, block_ string")
    listed = spark.createDataFrame([("x.org?u=a://b/c",), ("other.org/1",), (None,), ("x.org?u=a://b/c",)], "url string")
    found = sorted((tuple(r)[:5] for r in urls.url_verdicts(pages, listed, URL_RULES).collect()), key=repr)
    assert found == sorted(((r[0], *brute(r[1], r[1] == URLS[10])) for r in rows), key=repr)
    assert urls.url_verdicts(pages.limit(0), listed, URL_RULES).collect() == []
    empty = urls.url_verdicts(pages, listed.limit(0), []).collect()
    assert all(r["rule"] is None and r["verdict"] == "allow" for r in empty)


def test_the_filter_passes_all_listed_and_few_others(spark):
    listed = spark.range(3000).select(F.concat(F.lit("site.org/"), F.col("id")).alias("url"))
    table, blocks = urls.bloom_table(listed)
    probes = spark.range(30_000).select(F.concat(F.lit("site.org/"), F.col("id")).alias("url"), (F.col("id") < 3000).alias("truth"))
    at = probes.withColumn("block", urls._block(F.col("url"), blocks)).join(table, "block", "left")
    maybe = F.lit(True)
    for i, mask in enumerate(urls._masks(F.col("url"))):
        maybe = maybe & (F.coalesce(F.col(f"word_{i}"), F.lit(0)).bitwiseAND(mask) == mask)
    counts = {(r["truth"], r["maybe"]): r["count"] for r in at.withColumn("maybe", maybe).groupBy("truth", "maybe").count().collect()}
    assert counts[True, True] == 3000 and counts.get((True, False), 0) == 0
    assert 0 < counts.get((False, True), 0) < 0.02 * 27_000  # some false ones, which the exact join has to remove
    exact = urls.with_listed(probes, listed, "url", "listed")
    assert exact.count() == 30_000 and exact.where("listed != truth").count() == 0


def test_a_filter_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(urls, "BROADCAST_BLOCKS", 0)
    listed = spark.range(500).select(F.concat(F.lit("s/"), F.col("id")).alias("url"))
    pages = spark.range(2000).select(F.concat(F.lit("s/"), F.col("id")).alias("url"), (F.col("id") < 500).alias("truth"))
    assert urls.with_listed(pages, listed, "url", "listed").where("listed = truth").count() == 2000


def test_canonical(spark):
    cases = {
        "HTTP://A.org/x/": "a.org/x", "https://a.org/x?utm_source=1&ref=y#z": "a.org/x", "http://a.org/x?b=2&a=1": "a.org/x?a=1&b=2",
        "http://a.org/x?reference=1": "a.org/x?reference=1", "http://a.org": "a.org", "mailto:x": None, None: None,
    }
    rows = spark.createDataFrame([(u,) for u in cases], "url string").select("url", urls.canonical(F.col("url")).alias("c")).collect()
    assert {r["url"]: r["c"] for r in rows} == cases


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    plan = urls.url_verdicts(pages, urls.repeated_urls(pages), URL_RULES)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Nested|Cartesian", plan)
