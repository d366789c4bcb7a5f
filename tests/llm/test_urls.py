from panelwise.llm import urls
from panelwise.llm.queries import RULES

URLS = [
    "https://A.Example.NET/en/x?q=1", "http://example.net", "HTTP://www.example.com/de/#f", "https://x.example.com/DE/", "http://b.org/fr/1", "http://borg/fr/1",
    "nothing here", "", None, "https://notexample.net/en/", "s3://h?x/y", "://host/p", "a://b://c/d", "http://ÄB.org/é?x", "http://x.org:80/fr/",
]


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    return host, tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]


def rule(host, path):
    fit = []
    for kind, r in RULES:
        top, _, rest = r.partition("/")
        if (host == top or host.endswith("." + top)) and path.startswith("/" + rest):
            fit.append((len(r), r, kind))
    return max(fit)[1:] if fit else (None, None)


def judged(spark, pages, labels):
    p = spark.createDataFrame(pages, "page_id long, url string, host string, n int")
    return urls.judge(p, spark.createDataFrame(labels, "id long, bad int"), RULES)


def test_hosts_paths_and_rules(spark):
    got = {r.id: r for r in judged(spark, [(k, u, "clash", 1) for k, u in enumerate(URLS)], []).collect()}
    for k, u in enumerate(URLS):
        host, path = plain(u)
        name, kind = rule(host, path)
        assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == (host, path, name, kind or "allow"), u


def test_bad_hosts_are_blocked_by_their_bound(spark):
    hosts = ["bad.a.org"] * 40 + ["good.a.org"] * 400 + ["www.c.com"] * 400
    pages = [(k, f"http://{h}/x", "", 0) for k, h in enumerate(hosts)] + [(None, "http://bad.a.org/y", "", 0)] * 2
    labels = [(k, int(h == "bad.a.org")) for k, h in enumerate(hosts)] + [(0, 0), (None, 1), (5, None)]
    got = judged(spark, pages, labels).collect()
    assert len(got) == len(pages)
    verdict = {(r.host, r.verdict) for r in got}
    assert verdict == {("bad.a.org", "block"), ("good.a.org", "allow"), ("www.c.com", "allow")}
    assert judged(spark, pages[:0], labels).count() == 0
    assert {r.verdict for r in judged(spark, pages, []).collect()} == {"allow"}
