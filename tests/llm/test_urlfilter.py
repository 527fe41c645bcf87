"""URL filter: rules row by row, flows against plain power iteration."""

import re

import pytest
from pyspark.sql import functions as F

from leadloom.llm import urlfilter

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/")]
PAGES = [
    (1, "http://A.example.com/en/x?q=1", "see https://hub.example.org/x and b.example.net."),
    (2, "https://www.example.com/en/y", None), (3, "ftp://b.example.net/es/1#f", '<a href="//spam.example.net/">'),
    (4, "https://b.example.net/de/1", ""), (5, None, "c.example.org"), (6, "no scheme/com/", "x"),
    (7, "https://hub.example.org", "spam.example.net and spam.example.net"), (8, "http://spam.example.net/fr/", ""),
    (9, "http://spam.example.net/en/", ""), (10, "http://example.com?en/", "hub.example.org"),
    (10, "http://example.com?en/", "hub.example.org"), (11, "x://com/a://b/c", ""), (12, "://", ""),
    (13, "http://lone.example.org/en/", "nothing"), (14, "http://a.example.com/de\n/x", "HUB.example.org")]


def table(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string").select(
        "*", F.lit("z").alias("host"), F.lit(1).alias("path"), F.lit(2).alias("weight"), F.lit(3).alias("fits"))


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_for(host, path):
    fits = []
    for action, rule in RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, action))
    return max(fits, default=(0, None, None))[1:]


def brute(rows, rounds=10, damping=0.85):
    judged = [(i, *parts(u), *rule_for(*parts(u)), h or "") for i, u, h in rows]
    hosts = {j[1] for j in judged} - {""}
    weight = {}
    for _, host, _, _, _, html in judged:
        names = {n.lower() for n in set(re.findall(r"(?<![\w.-])[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", html))}
        for n in names & hosts - {host}:
            if host:
                weight[host, n] = weight.get((host, n), 0) + 1
    seed = {a: {h: sum(j[1] == h and j[4] == a for j in judged) for h in hosts} for a in ("allow", "block")}
    seed = {a: {h: n / (sum(s.values()) or 1) for h, n in s.items()} for a, s in seed.items()}
    trust, bad = dict(seed["allow"]), dict(seed["block"])
    for _ in range(rounds):
        t, b = dict.fromkeys(hosts, 0.0), dict.fromkeys(hosts, 0.0)
        for (s, d), w in weight.items():
            t[d] += trust[s] * w / sum(v for (x, _), v in weight.items() if x == s)
            b[s] += bad[d] * w / sum(v for (_, y), v in weight.items() if y == d)
        trust = {h: (1 - damping) * seed["allow"][h] + damping * t[h] for h in hosts}
        bad = {h: (1 - damping) * seed["block"][h] + damping * b[h] for h in hosts}
    out = []
    for i, host, path, rule, action, _ in judged:
        own = "block" if bad.get(host, 0) > 0 and bad[host] >= 0.5 * (trust[host] + bad[host]) else "allow"
        out.append((i, host, path, rule, action or own, trust.get(host), bad.get(host)))
    return sorted(out, key=str)


def test_against_plain_iteration(spark):
    got = sorted([tuple(r) for r in urlfilter.judge(table(spark), RULES).collect()], key=str)
    want = brute(PAGES)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert (g[5], g[6]) == (None, None) if w[5] is None else g[5:] == pytest.approx(w[5:])
    assert {(g[0], g[4]) for g in got} >= {(4, "block"), (9, "block"), (13, "allow"), (5, "allow")}


def test_empty(spark):
    assert urlfilter.judge(table(spark).limit(0), RULES).collect() == []


def test_chain_of_more_than_ten_hosts(spark):
    n = 14
    rows = [(i, f"http://h{i}.example.org/", f"see h{i + 1}.example.org") for i in range(n)]
    rows += [(n, f"http://h{n}.example.org/es/", "h13.example.org"), (n + 1, f"http://h{n}.example.org/", None)]
    got = {r.page_id: r for r in urlfilter.judge(table(spark, rows), [("block", f"h{n}.example.org/es/")]).collect()}
    weight = {(i, i + 1): 1 for i in range(n)} | {(n, n - 1): 1}
    bad = dict.fromkeys(range(n + 1), 0.0)
    for _ in range(400):
        sent = {s: sum(bad[d] * w / sum(v for (_, y), v in weight.items() if y == d)
                       for (x, d), w in weight.items() if x == s) for s in bad}
        bad = {h: 0.15 * (h == n) + 0.85 * sent[h] for h in bad}
    assert all(got[i].verdict == "block" and got[i].distrust == pytest.approx(bad[i], abs=1e-5) for i in range(n))
    assert got[0].distrust > 0 and got[n + 1].verdict == "block"
