"""URL filters on hostile rows: host, path and rules against plain Python, and the shrinkage against closed forms."""

import random

from pyspark.sql import functions as F

from caseloom.llm import url_filter

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
URLS = [
    None, "", "no scheme", "http://", "http://A.Example.ORG/es/1", "https://example.org/en/12?x=/es/#y", "http://example.org", "http://notexample.org/es/", "http://x.org?/es/", "HTTP://COM/fr/", "http://shop.com/FR/", "http://shop.com/de/?q", "ftp://ünï.example.net:80/a b\nc/#x",
    "a://b://c/d", "http://10.0.0.1/x", "http://user@deep.shop.co.uk:8080/p", "x" * 300_000 + "://h.com/de/" + "y" * 300_000,
]


def plain(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    return rest[:end].translate({c: c + 32 for c in range(65, 91)}), path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def rows(spark):
    d = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(4, URLS[4], "h"), (None, URLS[4], "h")], "page_id long, url string, html string")
    return d.withColumns({c: F.lit(1) for c in ("host", "path", "rule", "verdict", "blocked", "n", "k", "bad", "domain", "suffix", "m")}).repartition(3)


def outcomes(spark, rows):
    return spark.createDataFrame(rows, "page_id long, bad boolean")


def test_host_path_and_rules(spark):
    found = url_filter.judge(rows(spark), outcomes(spark, [(4, True), (None, True), (5, None)]), RULES).collect()
    assert len(found) == len(URLS) + 2
    for r in found:
        host, path = plain(URLS[4 if r["page_id"] is None else r["page_id"]])
        fits = [x for x in RULES if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])]
        rule = max(fits, key=lambda x: len(x[0] + x[1]), default=None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[0] + rule[1]), r["page_id"]
        assert r["verdict"] == rule[2] if rule else r["verdict"] in ("allow", "block")
    assert url_filter.judge(rows(spark).limit(0), outcomes(spark, []), RULES).count() == 0
    assert url_filter.judge(rows(spark), outcomes(spark, []), []).filter("rule is null").count() == len(URLS) + 2


def test_levels_of_a_host(spark):
    names = {"a.b.shop.co.uk": ("shop.co.uk", "co.uk"), "shop.com": ("shop.com", "com"), "localhost": ("localhost", "localhost"), "co.uk": ("co.uk", "co.uk"), "u@x.y.net:80": ("y.net", "net"), "10.0.0.1": ("10.0.0.1", ""), "": ("", "")}
    found = url_filter.with_levels(spark.createDataFrame([(x,) for x in names], "host string")).collect()
    assert {r["host"]: (r["domain"], r["suffix"]) for r in found} == names


def test_reputation_shrinks_by_evidence(spark):
    """Against the same formulas in plain Python; a host with much evidence keeps its share, one with none takes its domain's."""
    r = random.Random(5)
    hosts = {f"h{i}.d{i % 7}.{'com' if i % 2 else 'net'}": (n, sum(r.random() < (0.9 if i % 7 == 3 else 0.1) for _ in range(n))) for i in range(60) for n in [r.choice([0, 1, 5, 400])]}
    found = {x["host"]: x for x in url_filter.reputation(spark.createDataFrame([(h, *v) for h, v in hosts.items()], "host string, n long, k long")).collect()}

    def worth(members):
        over = sum((k - n * m) ** 2 - n * m * (1 - m) for n, k, m in members)
        room = sum(n * (n - 1) * m * (1 - m) for n, k, m in members)
        return 1 / min(max(over / room, url_filter.RHO_MIN), url_filter.RHO_MAX) - 1

    def summed(key):
        out = {}
        for h, (n, k) in hosts.items():
            a, b = out.get(key(h), (0, 0))
            out[key(h)] = (a + n, b + k)
        return out

    domain, suffix = (lambda h: ".".join(h.split(".")[-2:])), (lambda h: h.split(".")[-1])
    top = (sum(k for _, k in hosts.values()) + 1) / (sum(n for n, _ in hosts.values()) + 2)
    s, d = summed(suffix), summed(domain)
    ws = worth([(*v, top) for v in s.values()])
    s_mean = {x: (k + ws * top) / (n + ws) for x, (n, k) in s.items()}
    wd = worth([(*v, s_mean[suffix(x)]) for x, v in d.items()])
    d_mean = {x: (k + wd * s_mean[suffix(x)]) / (n + wd) for x, (n, k) in d.items()}
    wh = worth([(*v, d_mean[domain(x)]) for x, v in hosts.items()])
    for h, (n, k) in hosts.items():
        mean = (k + wh * d_mean[domain(h)]) / (n + wh)
        assert abs(found[h]["mean"] - mean) < 1e-9 and abs(found[h]["bound"] - mean - 1.645 * (mean * (1 - mean) / (n + wh + 1)) ** 0.5) < 1e-9
        if n == 0:
            assert abs(found[h]["mean"] - d_mean[domain(h)]) < 1e-9
        if n == 400:
            assert abs(found[h]["mean"] - k / n) < 0.1


def test_a_bad_host_is_blocked_and_its_neighbours_are_not(spark):
    pages = [(i, f"http://{'spam' if i % 2 else 'good'}.site{i % 4}.net/p{i}") for i in range(400)]
    found = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), outcomes(spark, [(i, i % 2 == 1 and i % 10 != 1) for i in range(0, 400)]), RULES).collect()
    assert {r["verdict"] for r in found if r["host"].startswith("spam")} == {"block"} and {r["verdict"] for r in found if r["host"].startswith("good")} == {"allow"}
