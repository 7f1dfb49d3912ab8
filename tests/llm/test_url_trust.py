import re

import pytest

from assetloom.llm.url_trust import RULES, judge, op4_url_trust, propagate

SCHEMA = "page_id long, url string, html string"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path, rules=RULES):
    fit = [(-len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return min(fit)[1:] if fit else None


def brute_ranks(seeds, edges, damping=0.85, rounds=400):
    hosts = set(seeds) | {h for a, b, _ in edges for h in (a, b)}
    out = {h: sum(n for a, _, n in edges if a == h) for h in hosts}
    rank = {h: seeds.get(h, 0.0) for h in hosts}
    for _ in range(rounds):
        new = {h: (1 - damping) * seeds.get(h, 0.0) + (0 if out[h] else damping * rank[h]) for h in hosts}
        for a, b, n in edges:
            new[b] += damping * rank[a] * n / out[a]
        rank = new
    return rank


def test_propagation_equals_brute_force(spark):
    edges = [("a", "b", 2), ("b", "c", 1), ("c", "a", 1), ("b", "d", 3), ("e", "d", 1), ("a", "e", 1)]
    seeds = {"a": (1.0, 0.0), "d": (0.0, 1.0), "z": (0.25, 0.5)}
    got = propagate(spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, trust double, distrust double"), spark.createDataFrame(edges, "src string, dst string, n long"), damping=0.5, tolerance=1e-6).collect()
    trust = brute_ranks({h: s[0] for h, s in seeds.items()}, edges, 0.5)
    distrust = brute_ranks({h: s[1] for h, s in seeds.items()}, [(b, a, n) for a, b, n in edges], 0.5)
    assert {r.host for r in got} == set(trust)
    for r in got:
        assert r.trust == pytest.approx(trust[r.host], abs=1e-4) and r.distrust == pytest.approx(distrust[r.host], abs=1e-4)


def test_links_spread_trust_and_distrust(spark):
    link = lambda *hosts: "".join(f'<a class="x" href="https://{h}/p?q">x</a>' for h in hosts) + '<a href="/own">own</a>'
    rows = [
        (1, "http://bad.net/x", link()), (2, "http://fan.com/x", link("bad.net", "bad.net")), (3, "http://good.org/fr/x", link("Friend.com")), (4, "http://friend.com/x", link("good.org")),
        (5, "http://example.com/de/x", None), (6, "http://example.com/", "<a href=//bad.net/>"), (7, None, None), (8, "no scheme", None), (9, "HTTPS://WWW.Example.NET/en/?a://b", ""), (10, "http://bare.net", ""),
        (2, "http://fan.com/x", link("bad.net")), (None, "://?x", None),
    ]
    pages = spark.createDataFrame([(*r, "h") for r in rows], SCHEMA + ", host string")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    got = judge(pages, rules, damping=0.7, tolerance=1e-3).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert [by[i].verdict for i in (1, 2, 3, 4, 5, 7, 8, 9, 10)] == ["block", "block", "allow", "allow", "block", "allow", "allow", "allow", "allow"]
    assert by[9].rule == "example.net/en/" and by[1].rule == "net/" and by[10].rule is None and by[10].path == ""
    assert by[6].distrust > 0.5 and by[6].rule is None and by[4].trust > 0.3
    assert (by[7].host, by[7].path, by[None].host) == ("", "", "")
    assert judge(pages.limit(0), rules).count() == 0
    assert [r.verdict for r in judge(pages, rules.limit(0), damping=0.5, tolerance=1e-3).collect()] == ["allow"] * len(rows)


def test_verdicts_at_production_damping(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/p">x</a>' for h in hosts)
    rows = [(1, "http://bad.net/x", ""), (2, "http://bad.net", ""), (3, "http://bad.net/y", "")]  # page 2 has no rule
    rows += [(10 + i, f"http://fan{i}.com/x", link("bad.net")) for i in range(6)]
    rows += [(20, "http://directory.com/x", link("bad.net", *(f"plain{i}.com" for i in range(30)))), (21, "http://good.org/fr/x", link("liked.com")), (22, "http://liked.com/x", link("plain1.com"))]
    pages = spark.createDataFrame(rows, SCHEMA)
    got = {r.page_id: r for r in judge(pages, spark.createDataFrame(RULES, "verdict string, host string, path string")).collect()}
    assert got[2].rule is None and [got[i].verdict for i in (1, 2, 3)] == ["block"] * 3  # a linked seed
    assert [got[10 + i].verdict for i in range(6)] == ["block"] * 6  # several linkers
    assert [got[i].verdict for i in (20, 21, 22)] == ["allow"] * 3


def test_domains_decide_verdicts(spark):
    """Relative links only: a host without rules is judged by its domain's other hosts, here unlike by its own seeds."""
    rows = [(i, f"http://h{i}.bad.com/de/x", '<a href="/own">own</a>') for i in range(12)] + [(50, "http://new.bad.com/x", None), (51, "http://new.good.com/x", None), (52, "http://alone.com/x", None)]
    rules = spark.createDataFrame([("block", "bad.com", "/de/")], "verdict string, host string, path string")
    got = {r.page_id: r.verdict for r in judge(spark.createDataFrame(rows, SCHEMA), rules, tolerance=1e-3).collect()}
    assert (got[0], got[50], got[51], got[52]) == ("block", "block", "allow", "allow")


def brute_shares(seeds, edges):
    """What each host gets along edges, as a part of what it would get if every host had a full seed."""
    hosts = set(seeds) | {h for a, b, _ in edges for h in (a, b)}
    out = {h: sum(n for a, _, n in edges if a == h) for h in hosts}
    got = []
    for ranks in (brute_ranks(seeds, edges), brute_ranks(dict.fromkeys(hosts, 1.0), edges)):
        sums = dict.fromkeys(hosts, 0.0)
        for a, b, n in edges:
            sums[b] += ranks[a] * n / out[a]
        got.append(sums)
    return {h: got[0][h] / got[1][h] if got[1][h] else 0.0 for h in hosts}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, sf):
    sf = f"/root/testdata/{sf}"
    pages = {p.page_id: p for p in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op4_url_trust(spark, sf).collect()
    assert len(got) == len(pages)
    ruled, edges = {}, {}
    for p in pages.values():
        host, path = split(p.url)
        fit = rule_of(host, path)
        ruled.setdefault(host, []).append(fit and fit[1])
        for href in re.findall(r"""(?i)<a\s(?:[^>]*\s)?href\s*=\s*["']?([^"'\s>]+)""", p.html):
            if re.match("(?i)(https?:)?//", href) and split("http:" + href[href.index("//") :])[0] != host:
                edge = host, split("http:" + href[href.index("//") :])[0]
                edges[edge] = edges.get(edge, 0) + 1
    for low, high in {(".".join(x[i:]), ".".join(x[i + 1 :])) for x in (h.split(".") for h in ruled) for i in range(len(x) - 2)}:
        edges[low, high] = edges.get((low, high), 0) + 1
        edges[high, low] = edges.get((high, low), 0) + 1
    edges = [(*e, n) for e, n in edges.items()]
    assert edges
    own = {h: [x.count(v) / len(x) for v in ("allow", "block")] for h, x in ruled.items()}
    trust = brute_shares({h: x[0] for h, x in own.items()}, edges)
    distrust = brute_shares({h: x[1] for h, x in own.items()}, [(b, a, n) for a, b, n in edges])
    moved = 0
    for r in got:
        host, path = split(pages[r.page_id].url)
        fit = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, fit and fit[0])
        alone = own[host][1] - own[host][0]
        excess = max(alone, alone + (1 - sum(own[host])) * (distrust[host] - trust[host]))
        if fit or abs(excess - 0.5) > 0.02:
            assert r.verdict == (fit[1] if fit else "block" if excess >= 0.5 else "allow")
        moved += not sum(own[host]) and r.distrust > 0.001
    assert moved  # hosts without seeds of their own are judged by what edges bring
