import re

import pytest

from cohortlake.llm import url_filters as uf
from tests.oracle import connect, differences

URLS = [None, "", "no scheme/x", "http://a.net/x?y#z", "http://a.net", "HTTP://EXAMPLE.NET/en/1", "http://x.example.net/en/",
        "http://x.example.net/enx", "http://badexample.com/de/", "http://example.com/de/x", "https://b.org/fr/1", "https://b.org/de/",
        "x://y://z.net/a", "http://org/fr/#x", "http://example.net/EN/", "http://" + "a." * 2000 + "net/" + "b/" * 2000, "http://net:80/",
        "http://.net/", "http:///en/", "http://ÄB.net/é\n/x", "http://a.net?b/c", "://"]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def by_hand(url, rules):
    host, path = parts(url)
    fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, "allow"
    most = max(len(r) for r, _ in fits)
    best = [(r, v) for r, v in fits if len(r) == most]
    return host, path, best[0][0], "block" if any(v == "block" for _, v in best) else "allow"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, _rule string")


def rules_table(spark, rules):
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def test_verdicts_equal_the_plain_rule(spark):
    out = uf.url_verdicts(pages(spark, URLS * 2), rules_table(spark, uf.RULES), keep=["page_id"]).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in out] == [by_hand(u, uf.RULES) for u in URLS * 2]


def test_many_keys_in_parts(spark, monkeypatch):
    monkeypatch.setattr(uf, "BITS_PER_KEY", 2)  # many false positives, so several levels
    monkeypatch.setattr(uf, "MOST_KEYS", 150)
    rules = [(f"h{i}.com", "/" if i % 3 else "/a/", "block" if i % 2 else "allow") for i in range(300)] + [("h9.com", "/", "block")]
    urls = [f"http://w.h{i}.com/{'a/' if i % 4 else ''}x" for i in range(0, 900)] + URLS
    out = uf.url_verdicts(pages(spark, urls), rules_table(spark, rules), keep=["page_id"]).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in out] == [by_hand(u, rules) for u in urls]


def test_empty_tables_and_bad_rules(spark):
    none = rules_table(spark, uf.RULES).limit(0)
    assert uf.url_verdicts(pages(spark, URLS).limit(0), rules_table(spark, uf.RULES), keep=["page_id"]).count() == 0
    assert {r.verdict for r in uf.url_verdicts(pages(spark, URLS), none, keep=["page_id"]).collect()} == {"allow"}
    with pytest.raises(ValueError):
        uf.url_verdicts(pages(spark, URLS), rules_table(spark, [("net", "/x", "block")]))


def test_query_equals_sql_without_python(spark, sf_dir):
    from cohortlake.llm.registry import ORACLES

    df = uf.op3_url_filters(spark, sf_dir)
    assert differences(df, connect(sf_dir), ORACLES["op3_url_filters"]) == []
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop|Join", plan.split("Subquery")[0])
