import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import url_filter
from quarry.llm.queries import URL_RULES

URLS = [None, "", "no scheme", "https://WWW.Example.COM/en/71?x#y", "https://example.com", "https://example.com?q=/en/7", "https://a.example.net/de/8", "https://example.net/de/9", "ftp://x.org/es/", "https://bad.test/a", "https://bad.test:80/a", "https://xcom/en/1", "a://b://c/d", "https://com/en/", "https://Ünï.com/en/#z", "https://bad.test/a", "https://line\nbreak.org/es/x"]


def frame(spark, urls=URLS):
    return spark.createDataFrame([(i, u, "h", True) for i, u in enumerate(urls)], "page_id bigint, url string, a string, _b boolean")


def plain(url, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        tail = rest[end:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    best = None
    for rule in URL_RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and (best is None or len(rule) > len(best)):
            best = rule
    return host, path, best, URL_RULES[best] if best else "block" if host in listed else "allow"


@pytest.mark.parametrize("sizes", [{}, {"broadcast_bytes": 0}, {"per_shard": 1, "broadcast_bytes": 0}])
def test_verdicts(spark, sizes):
    listed = ["bad.test", "not-there.test", None]
    found = url_filter.judge(frame(spark), URL_RULES, spark.createDataFrame([(h,) for h in listed], "host string"), **sizes).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found} == {i: plain(u, listed) for i, u in enumerate(URLS)}
    assert all(r.a == "h" and r._b for r in found)


def test_clashing_names_stay(spark):
    names = ["_Listed", "_listed_", "host", "Path", "rule", "verdict", "key", "a", "b", "shard", "salt", "row"]
    df = spark.createDataFrame([(i, u, *[f"{n}{i}" for n in names]) for i, u in enumerate(URLS)], ", ".join(["page_id bigint", "url string", *(f"{n} string" for n in names)]))
    hosts = spark.createDataFrame([("bad.test",)], "host string")
    found = url_filter.judge(df, URL_RULES, hosts).toPandas()
    kept = [{"host": "host_", "Path": "Path_", "rule": "rule_", "verdict": "verdict_"}.get(n, n) for n in names]
    assert list(found.columns) == ["page_id", "url", *kept, "host", "path", "rule", "verdict"]
    assert all(found[c].tolist() == [f"{n}{i}" for i in found["page_id"]] for n, c in zip(names, kept))
    assert found["verdict"].tolist() == [plain(URLS[i], ["bad.test"])[3] for i in found["page_id"]]
    # the url itself may have the name of an added column
    again = url_filter.judge(df.select("page_id", F.col("url").alias("HOST")), URL_RULES, hosts, url_col="HOST").toPandas()
    assert again["verdict"].tolist() == [plain(URLS[i], ["bad.test"])[3] for i in again["page_id"]]


@pytest.mark.parametrize("sizes", [{}, {"per_shard": 50}, {"per_shard": 50, "broadcast_bytes": 0}])
def test_cascade_is_exact_over_its_universe(spark, sizes):
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("k"), "id")
    listed = keys.where("id % 7 = 0").select("k").union(spark.createDataFrame([("elsewhere",)], "k string"))
    made = url_filter.cascade(keys.select("k"), listed, **sizes)
    wrong = made.mark(keys, F.col("k"), "listed").where(F.col("listed") != (F.col("id") % 7 == 0))
    assert wrong.count() == 0


def test_keys_that_no_level_parts_are_kept():
    a, b = np.array([5, 6], np.uint64), np.array([7, 8], np.uint64)
    made = url_filter.Cascade.deeper((a, b), (a[:0], b[:0]))
    assert made.holds(a, b).all()
    stuck = url_filter.Cascade([], np.array([[5, 7]], np.uint64))
    assert stuck.holds(a, b).tolist() == [True, False]


def test_empty_tables_and_lists(spark):
    hosts = spark.createDataFrame([], "host string")
    assert url_filter.judge(frame(spark, []), URL_RULES, hosts).count() == 0
    assert {r.verdict for r in url_filter.judge(frame(spark), {}, hosts).collect()} == {"allow"}
