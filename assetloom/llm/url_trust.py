"""URL filter with link-graph propagation, with DataFrame functions only.

Rules (host, path) allow or block a URL; the longest fitting rule wins. Pages without a rule are
judged by their host: trust flows from hosts whose pages rules allow along links, distrust flows from
hosts whose pages rules block against links (who links to bad hosts is suspect). Both are personalised
PageRanks, each host's seed being the share of its pages that rules allow or block. The size of a rank
says how a host is linked, so what a host gets along links is divided by what it would get if every host
had a full seed: the share of trusted (distrusted) origins in it, whoever else shares them. The ruled
part of a host's pages speaks for itself, these shares speak for the rest. A host whose distrust so
exceeds its trust by ``threshold`` or more, or whose seeds alone do, is blocked, any other allowed.
Links of a host to itself say nothing. Host edges are the links of pages, as often as they occur, and, once each way, the
edges between a host and the domain directly above it (of two labels or more): a domain answers for what it
hands out, and the other way round. So hosts hang together where pages only link to their own host.
A host without edges keeps its own seed.

Only hosts and distinct host edges enter the iteration. It runs until no score moves by more than
``tolerance`` and cuts its lineage every few rounds by a table in the shared folder.

Defined results: a null URL or one without ``://`` has empty host and path, no rule, and is allowed;
null html has no links; of rules of equal length that fit, the first in text order wins; repeated
rows give repeated results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_skewed

#: The rules of the registered query.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HREF = r"""(?i)<a\s(?:[^>]*\s)?href\s*=\s*["']?([^"'\s>]+)"""


def _after_scheme(url: Column) -> Column:
    return F.when(F.locate("://", url) > 0, url.substr(F.locate("://", url) + 3, F.length(url)))


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): the rules of each host and of the domains above it, the longest first."""
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    domains = hosts.select("host", F.explode(above).alias("domain"))
    own = rules.select(F.col("host").alias("domain"), F.struct((-F.length(F.concat("host", "path"))).alias("order"), F.concat("host", "path").alias("rule"), F.col("path").alias("prefix"), "verdict").alias("entry"))
    return domains.join(own, "domain").groupBy("host").agg(F.sort_array(F.collect_set("entry")).alias("rules"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links from pages of one host to another, counted."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1))).alias("href"))
    full = F.when(F.col("href").startswith("//"), F.concat(F.lit("http:"), "href")).otherwise(F.col("href"))
    links = links.where(F.col("href").rlike("(?i)^(https?:)?//")).select("src", host(full).alias("dst"))
    return links.where((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def domain_edges(hosts: DataFrame) -> DataFrame:
    """(src, dst, n): each host and the domain directly above it, then that and the next, both ways; a domain has two labels at least."""
    labels = F.split("host", r"\.")
    up = F.transform(F.sequence(F.lit(1), F.size(labels) - 2), lambda i: F.struct(F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("low"), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".").alias("high")))
    steps = hosts.where(F.size(labels) > 2).select(F.explode(up).alias("x")).select("x.low", "x.high").distinct()
    return steps.select(F.explode(F.array(F.struct(F.col("low").alias("src"), F.col("high").alias("dst")), F.struct(F.col("high").alias("src"), F.col("low").alias("dst")))).alias("x")).select("x.src", "x.dst", F.lit(1).cast("long").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-3, most_rounds: int = 200, rounds_per_cut: int = 2) -> DataFrame:
    """(host, trust, distrust, trust_share, distrust_share) from seeds (host, trust, distrust) over edges (src, dst, n).

    Trust passes along edges, distrust against them, each split by the edges' counts. A share is what a host
    got last, divided by what it would have got if every seed were 1; 0 if it gets nothing. Raises if scores haven't settled after ``most_rounds``.
    """
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    shares = cut(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("share")), "trust-edges")
    linked = shares.select("kind", F.col("src").alias("host")).distinct().withColumn("linked", F.lit(True))
    hosts = seeds.select("host").unionByName(edges.select(F.explode(F.array("src", "dst")).alias("host"))).distinct()
    start = hosts.join(seeds, "host", "left").select("host", F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.coalesce("trust", F.lit(0.0)).alias("seed")), F.struct(F.lit("distrust").alias("kind"), F.coalesce("distrust", F.lit(0.0)).alias("seed")))).alias("x")).select("host", "x.*")
    ranks = cut(start.join(linked, ["kind", "host"], "left").select("kind", "host", "seed", F.coalesce("linked", F.lit(False)).alias("linked"), F.col("seed").alias("rank"), F.col("seed").alias("before"), F.lit(1.0).alias("even"), F.lit(1.0).alias("even_before"), F.lit(0.0).alias("share")), "trust-ranks")
    for done in range(rounds_per_cut, most_rounds + 1, rounds_per_cut):
        for _ in range(rounds_per_cut):
            sent = ranks.select("kind", F.col("host").alias("src"), "rank", "even").join(shares, ["kind", "src"])
            got = sent.groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"), F.sum(F.col("even") * F.col("share")).alias("even_got"))

            def moved(name: str, seed: Column, got: str) -> Column:
                kept = F.when(F.col("linked"), F.lit(0.0)).otherwise(F.col(name))  # nowhere to go: it stays
                return (1 - damping) * seed + damping * (kept + F.coalesce(got, F.lit(0.0)))

            share = F.coalesce(F.when(F.col("even_got") > 0, F.col("got") / F.col("even_got")), F.lit(0.0))
            ranks = ranks.drop("share").join(got, ["kind", "host"], "left").select("kind", "host", "seed", "linked", moved("rank", F.col("seed"), "got").alias("rank"), F.col("rank").alias("before"), moved("even", F.lit(1.0), "even_got").alias("even"), F.col("even").alias("even_before"), share.alias("share"))
        ranks = cut(ranks, f"trust-ranks-{done}")
        if (ranks.agg(F.max(F.greatest(F.abs(F.col("rank") - F.col("before")), F.abs(F.col("even") - F.col("even_before"))))).first()[0] or 0.0) <= tolerance:
            break
    else:
        raise RuntimeError(f"scores still change by more than {tolerance} after {most_rounds} rounds")
    each = lambda kind, of: F.max(F.when(F.col("kind") == kind, F.col(of)))
    return ranks.groupBy("host").agg(*(each(kind, of).alias(kind + end) for of, end in (("rank", ""), ("share", "_share")) for kind in ("trust", "distrust")))


def judge(pages: DataFrame, rules: DataFrame, threshold: float = 0.5, key: str = "page_id", **options) -> DataFrame:
    """(key, host, path, rule, verdict, trust, distrust) of each page of (key, url, html); rules: (verdict, host, path); options: of ``propagate``."""
    split = pages.select(F.col(key), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    hosts = cut(split.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "trust-hosts")
    candidates = hosts.join(host_rules(hosts.select("host"), rules), "host", "left")
    fit = F.get(F.filter("rules", lambda r: F.col("path").startswith(r.prefix)), 0)
    ruled = join_skewed(split, candidates, ["host"], "pages").select(key, "host", "path", fit.alias("fit"))
    of = lambda verdict: F.avg(F.when(F.col("fit.verdict") == verdict, 1.0).otherwise(0.0))
    seeds = ruled.where("host != ''").groupBy("host").agg(of("allow").alias("trust"), of("block").alias("distrust"))
    edges = host_edges(pages.select(host(F.col("url")).alias("host"), "html")).unionByName(domain_edges(hosts.select("host")))
    edges = cut(edges.groupBy("src", "dst").agg(F.sum("n").alias("n")), "host-edges")
    seeds = cut(seeds, "trust-seeds")
    scores = propagate(seeds, edges, **options).join(seeds.select("host", F.col("trust").alias("own_trust"), F.col("distrust").alias("own_distrust")), "host", "left")
    own = F.coalesce(F.col("own_distrust") - F.col("own_trust"), F.lit(0.0))
    unruled = F.greatest(1 - F.coalesce(F.col("own_distrust") + F.col("own_trust"), F.lit(0.0)), F.lit(0.0))
    excess = F.greatest(own, own + unruled * (F.col("distrust_share") - F.col("trust_share")))
    scores = scores.select("host", "trust", "distrust", excess.alias("excess"))
    by_host = F.when(F.col("excess") >= threshold, "block").otherwise("allow")
    scores = hosts.join(scores, "host", "left")
    return join_skewed(ruled, scores, ["host"], "pages").select(key, "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", by_host).alias("verdict"), "trust", "distrust")


def op4_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages, spark.createDataFrame(RULES, "verdict string, host string, path string"))
