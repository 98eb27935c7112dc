"""The URL filter, against a plain computation and its own SQL."""

from __future__ import annotations

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from thermoband.llm import catalogue, host_reputation
from thermoband.llm.host_reputation import Rule
from thermoband.mixed.special import beta_inc

RULES = catalogue.URL_RULES
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
URLS = [
    None, "", "nothing here", "://", "http://", "http:///en/", "HTTPS://WWW.Example.NET/En/1", "http://example.net/en/1?x#y", "http://a.example.net/en",
    "http://badexample.net/en/1", "http://net/x", "http://x.net?/en/", "http://x.net#f", "x://example.com/de/5://z.org/fr/", "http://é.org/fr/ü?q", "http://org/fr/",
    "http://example.com:80/de/", "http://u@example.com/de/\n/x", "http://a..b./", "http://" + "a" * 50_000 + ".com/de/", "http://İ.NET/", "//x://example.com/de/7", "http://xexample.com/de/",
]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return host.translate(LOWER), path


def plain_rule(host, path, rules):
    fit = [r for r in rules if (host == (h := r.where.partition("/")[0]) or host.endswith("." + h)) and path.startswith(r.where[len(h) :])]
    return max(fit, key=lambda r: len(r.where), default=None)


def plain_weight(groups):
    rows = [(n, k, m) for n, k, m in groups if n]
    together = sum(m * (1 - m) * (n - 1) for n, k, m in rows)
    held = (sum(n * (k / n - m) ** 2 for n, k, m in rows) - sum(m * (1 - m) for *_, m in rows)) / together if together else None
    return 1.0 if held is None else min(max(1 / held - 1, 1.0), 10_000.0) if held > 0 else 10_000.0


def plain_reputations(counts, limit=0.5):
    """host -> (a, b, beyond) of counts host -> (n, bad)."""

    def registered(host):
        labels = host.split(".")
        long = ".".join(labels[-2:]) in host_reputation.SUFFIXES
        return ".".join(labels[-3 if long else -2 :]), ".".join(labels[-2 if long else -1 :])

    def summed(keys):
        out = {}
        for key, (n, k) in keys:
            a, b = out.get(key, (0, 0))
            out[key] = (a + n, b + k)
        return out

    domains = summed((registered(h), c) for h, c in counts.items())
    tops = summed((s, c) for (_, s), c in domains.items())
    every = (sum(k for _, k in tops.values()) + 1) / (sum(n for n, _ in tops.values()) + 2)

    def rates(level, prior):
        w = plain_weight([(n, k, prior(key)) for key, (n, k) in level.items()])
        return {key: (k + prior(key) * w) / (n + w) for key, (n, k) in level.items()}, w

    top_rate, _ = rates(tops, lambda s: every)
    domain_rate, _ = rates(domains, lambda d: top_rate[d[1]])
    _, w = rates(counts, lambda h: domain_rate[registered(h)])
    out = {}
    for h, (n, k) in counts.items():
        m = domain_rate[registered(h)]
        a, b = k + m * w, n - k + (1 - m) * w
        out[h] = (a, b, 1 - beta_inc(a, b, limit))
    return out


def counts_of_all_kinds():
    rng = random.Random(4)
    out = {}
    for domain, base in (("good.com", 0.05), ("farm.net", 0.9), ("mixed.co.uk", 0.5), ("thin.org", 0.6), ("none.org", 0.0)):
        for k in range(12):
            n = 0 if domain == "none.org" else rng.choice([0, 1, 3, 40, 5000])
            out[f"h{k}.{domain}"] = (n, sum(rng.random() < base for _ in range(n)))
    return out | {"": (3, 1), "localhost": (2, 2), "lone.dev": (900, 890), "co.uk": (1, 0)}


def test_reputations_against_plain(spark):
    counts = counts_of_all_kinds()
    rows = [(h, n - n // 3, k - k // 2, "c") for h, (n, k) in counts.items()] + [(h, n // 3, k // 2, "c") for h, (n, k) in counts.items()]
    rows += [(None, 5, 5, "c"), ("h0.good.com", None, 7, "c"), ("h0.good.com", 7, None, "c")]
    got = host_reputation.reputations(spark.createDataFrame(rows, "host string, n bigint, bad bigint, rate string"))
    got = {r.host: (r.a, r.b, r.beyond) for r in got.collect()}
    want = plain_reputations(counts)
    assert got.keys() == want.keys()
    for h, w in want.items():
        assert got[h] == pytest.approx(w, rel=1e-8, abs=1e-10), h


def test_shrinking_follows_the_levels(spark):
    """A host without outcomes is judged by its domain; one bad page of a good domain is not enough."""
    rows = [(f"h{k}.good.com", 50, 1) for k in range(20)] + [(f"h{k}.farm.net", 50, 49) for k in range(20)]
    rows += [("new.good.com", 0, 0), ("new.farm.net", 0, 0), ("once.good.com", 1, 1), ("often.good.com", 400, 390)]
    got = host_reputation.reputations(spark.createDataFrame(rows, "host string, n bigint, bad bigint"))
    blocked = {r.host for r in got.collect() if r.beyond >= 0.95}
    assert {"new.farm.net", "often.good.com"} <= blocked and not {"new.good.com", "once.good.com", "h3.good.com"} & blocked


def pages_frame(spark, urls):
    return spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)], "page_id bigint, url string, host string, verdict string").repartition(3)


def test_parts_and_rules_against_plain(spark):
    none = spark.createDataFrame([], "host string, n bigint, bad bigint")
    got = {r.page_id: r for r in host_reputation.judge(pages_frame(spark, URLS * 2), none, RULES).collect()}
    for i, url in enumerate(URLS * 2):
        host, path = plain_parts(url)
        rule = plain_rule(host, path, RULES)
        r = got[i]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule and rule.where, rule.verdict if rule else "allow"), url


def test_no_rules_no_pages(spark):
    none = spark.createDataFrame([], "host string, n bigint, bad bigint")
    assert host_reputation.judge(pages_frame(spark, URLS).limit(0), none, RULES).count() == 0
    assert {r.rule for r in host_reputation.judge(pages_frame(spark, URLS), none).collect()} == {None}
    assert host_reputation.reputations(none).count() == 0


def test_longest_rule_then_first(spark):
    none = spark.createDataFrame([], "host string, n bigint, bad bigint")
    rules = [Rule("block", "a.b/"), Rule("allow", "b/xy"), Rule("block", "b/xyz"), Rule("allow", "c.b/x"), Rule("block", "c.b/x")]
    urls = ["t://a.b/x", "t://a.b/xy", "t://a.b/xyz", "t://c.b/xyz", "t://b/xy", "t://b/x"]
    got = {r.page_id: (r.rule, r.verdict) for r in host_reputation.judge(pages_frame(spark, urls), none, rules).collect()}
    assert [got[i] for i in range(6)] == [("a.b/", "block"), ("a.b/", "block"), ("b/xyz", "block"), ("b/xyz", "block"), ("b/xy", "allow"), (None, "allow")]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Pages of good and bad hosts, a third of all on one host, pages repeated, labels repeated or null."""
    folder, rng = str(tmp_path_factory.mktemp("planted")), random.Random(9)
    labels, urls = [], list(URLS)
    for doc in range(3000):
        host, share = rng.choice([("hot.big.example.com", 0.1), ("m.spam.example.com", 0.97), ("www.x.example.org", 0.2), (f"w{doc % 40}.farm.dev", 0.95), (f"w{doc % 40}.fine.dev", 0.03)])
        host = "hot.big.example.com" if doc % 3 == 0 else host
        bad = rng.random() < (0.1 if doc % 3 == 0 else share)
        urls.append(f"http://{host}/en/{doc}?a")
        if doc % 2:
            labels.append((doc, 0 if bad and doc % 4 == 1 else 1, 1 if bad and doc % 4 == 3 else 0))
    urls += urls[100:140] * 20 + ["http://m.spam.example.com/about", "http://new.farm.dev/", "http://new.fine.dev/en/99999999999999999999"]
    labels += [(labels[0][0], None, 1), (None, 0, 1), (labels[1][0], None, None)]
    pages_frame(spark, urls).write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").repartition(2).write.parquet(f"{folder}/labels.parquet")
    return folder


def test_query_blocks_bad_hosts_as_its_sql(spark, planted):
    got = {tuple(r) for r in catalogue.op11_url_reputation(spark, planted).collect()}
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{planted}/{name}.parquet/*.parquet'")
    assert got == set(con.execute(catalogue.ORACLES["op11_url_reputation"]).fetchall())
    by_host = {h: v for _, h, _, rule, v in got if rule is None}
    assert by_host["m.spam.example.com"] == by_host["w3.farm.dev"] == by_host["new.farm.dev"] == "block"
    assert by_host["hot.big.example.com"] == by_host["w3.fine.dev"] == by_host["new.fine.dev"] == by_host["www.x.example.org"] == "allow"


def test_no_python_on_the_main_path(spark, planted):
    plan = catalogue.op11_url_reputation(spark, planted)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_outcomes(spark, sf_dir):
    pages, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("pages", "labels"))
    got = {r.host: (r.n, r.bad) for r in host_reputation.page_outcomes(pages, labels).collect()}
    known = {r.doc_id: r.quality == 0 or r.toxic == 1 for r in labels.collect()}
    want: dict = {}
    for host, doc in {(plain_parts(r.url)[0], int(plain_parts(r.url)[1].split("/")[2].split(".")[0])) for r in pages.select("url").collect()}:
        n, k = want.get(host, (0, 0))
        want[host] = (n + (doc in known), k + known.get(doc, False))
    assert got == want
