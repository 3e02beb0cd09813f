"""URL filters: path rules first, then trust and distrust spread over host links, in DataFrame operations only.

Rules (host, path prefix) fit a host and its subdomains; the longest fitting rule decides. Pages that no rule
fits get their host's verdict: personalised PageRank carries trust from hosts with allowed pages along links, and
the same walk on reversed links carries distrust from hosts with blocked pages to those that link to them.
Both walks run in one loop over one edge table (told apart by ``kind``), cut by written tables.

Skew: links are counted per (host, host) before any shuffle by host, so an edge occurs once however many
pages carry it. A very linked host is a join key of many edges; AQE splits that join, and sums are partial.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelvane.llm.common import Scratch, read

#: (host with path prefix, verdict)
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: Steps of the walks between written tables.
STEPS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING, TOLERANCE, THRESHOLD, SEED_SHARE = 0.85, 1e-6, 0.5, 0.5


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(length, rule, verdict) of the longest fitting rule, else null. ``rules``: a list of at most 1000."""
    if len(rules) > 1000:
        raise ValueError("rules are written into the plan; 1000 at most")
    fits = []
    for rule, verdict in rules:
        at = rule.index("/")
        name, prefix = rule[:at], rule[at:]
        fits.append(F.when(((host == name) | host.endswith(f".{name}")) & path.startswith(prefix), F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    none = F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    return F.greatest(none, none, *fits)


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts. Relative links stay on their host and are no edges."""
    links = F.regexp_extract_all("html", F.lit(r"""(?i)href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""), F.lit(1))
    # A page's links are counted within the page first, then per pair of hosts.
    return (
        pages.where(F.col("html").contains("//"))
        .select(host_of(F.col("url")).alias("src"), F.explode(links).alias("link"))
        .select("src", host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), "link")).otherwise(F.col("link"))).alias("dst"))
        .where((F.col("dst") != "") & (F.col("src") != "") & (F.col("src") != F.col("dst")))
        .groupBy("src", "dst").agg(F.count("*").alias("n"))
    )


def propagate(seeds: DataFrame, edges: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING, scratch: Scratch | None = None) -> DataFrame:
    """Personalised PageRank of each kind. seeds: (kind, host, seed), summing to 1 per kind; edges: (kind, src, dst, n).

    A step carries ``damping`` of each host's score along its links; all that is left, the teleports and the scores of hosts without links, goes
    to the seeds. Scores that are not given back to the seeds but lost are those scores times one number per kind, so steps go without giving back, and
    the end is scaled to sum 1 per kind. Steps go on, ``STEPS`` between written tables, until so many change the scores by at most ``tolerance`` in
    sum; each shrinks the change by ``damping`` at least, so that they end. Returns (kind, host, score).
    """
    scratch = scratch or Scratch(seeds.sparkSession)
    out = edges.groupBy("kind", "src").agg(F.sum("n").alias("out_n"))
    step = scratch.keep(edges.join(out, ["kind", "src"]).select(F.col("kind").alias("s_kind"), "src", "dst", (F.col("n") / F.col("out_n")).alias("p")))
    seeds = scratch.keep(seeds)
    if step.isEmpty():
        return seeds.withColumnRenamed("seed", "score")
    base = seeds.select("kind", "host", ((1 - damping) * F.col("seed")).alias("score"))
    score, old = base, None
    for _ in range(2 + math.ceil(math.log(tolerance / 2) / math.log(damping) / STEPS)):
        new = score
        for _ in range(STEPS):
            flow = new.join(step, (F.col("kind") == F.col("s_kind")) & (F.col("host") == F.col("src"))).select("kind", F.col("dst").alias("host"), (damping * F.col("score") * F.col("p")).alias("score"))
            new = base.unionByName(flow).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        new = scratch.keep(new)
        change = new.unionByName(score.withColumn("score", -F.col("score"))).groupBy("kind", "host").agg(F.sum("score").alias("c")).agg(F.sum(F.abs("c"))).first()[0]
        if old:
            scratch.drop(old)
        score = old = new
        if (change or 0.0) <= tolerance:
            total = score.groupBy("kind").agg(F.sum("score").alias("all"))
            return score.join(total, "kind").select("kind", "host", (F.col("score") / F.col("all")).alias("score"))
    raise RuntimeError(f"walks did not settle within {tolerance}")


def judge(pages: DataFrame, rules=RULES, *, tolerance: float = TOLERANCE, damping: float = DAMPING, threshold: float = THRESHOLD, seed_share: float = SEED_SHARE) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every page.

    A host is a seed of trust (distrust) if allow (block) rules fit at least ``seed_share`` of its pages; its weight
    is that share, scaled to sum 1 over all hosts. A host is blocked when distrust / (trust + distrust) is above ``threshold``; hosts that neither
    walk reaches are allowed. Null or odd urls have the empty host, which is judged like another; null html has no
    links; repeated rows count as often as they occur; an empty table gives an empty result; without rules every page is allowed; other columns
    are ignored.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark)
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    named = named.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    share = lambda v: F.avg(F.coalesce((F.col("best.verdict") == v), F.lit(False)).cast("double"))
    hosts = scratch.keep(named.groupBy("host").agg(share("allow").alias("allow"), share("block").alias("block")))
    seeds = hosts.select("host", F.explode(F.create_map(F.lit("trust"), "allow", F.lit("distrust"), "block")).alias("kind", "w")).where(F.col("w") >= seed_share)
    total = seeds.groupBy("kind").agg(F.sum("w").alias("all_w"))
    seeds = seeds.join(total, "kind").select("kind", "host", (F.col("w") / F.col("all_w")).alias("seed"))
    links = scratch.keep(host_edges(pages))
    edges = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    score = propagate(seeds, edges, tolerance, damping, scratch)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    verdicts = score.groupBy("host").agg(of("trust"), of("distrust")).withColumn("host_block", F.col("distrust") > F.lit(threshold) * (F.col("trust") + F.col("distrust"))).withColumnRenamed("host", "h")
    return named.join(verdicts, F.col("host") == F.col("h"), "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.when(F.coalesce("host_block", F.lit(False)), "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def oracle(rounds: int = 90, damping: float = DAMPING) -> str:
    """The same in SQL; after 90 rounds at most 2 * 0.85 ** 90 < 1e-6 of a walk can still change."""
    fit = ", ".join(f"('{r[: r.index('/')]}', '{r[r.index('/') :]}', '{r}', '{v}')" for r, v in RULES)
    host = lambda u: f"translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
    return f"""
WITH RECURSIVE rules(h, prefix, rule, verdict) AS (VALUES {fit}),
named AS (SELECT row_number() OVER () AS rid, page_id, html, coalesce({host("url")}, '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*(/[^?#]*)', 1), '') AS path FROM pages),
best AS (SELECT rid, arg_max(rule, length(rule)) AS rule, arg_max(r.verdict, length(rule)) AS verdict FROM named n JOIN rules r ON (n.host = r.h OR ends_with(n.host, '.' || r.h)) AND starts_with(n.path, r.prefix) GROUP BY rid),
judged AS (SELECT n.*, b.rule, b.verdict FROM named n LEFT JOIN best b USING (rid)),
shares AS (SELECT host, avg(coalesce(verdict = 'allow', false)::INT) AS trust, avg(coalesce(verdict = 'block', false)::INT) AS distrust FROM judged GROUP BY host),
raw AS (SELECT 'trust' AS kind, host, trust AS w FROM shares UNION ALL SELECT 'distrust', host, distrust FROM shares),
seeds AS (SELECT kind, host, w / sum(w) OVER (PARTITION BY kind) AS seed FROM raw WHERE w >= {SEED_SHARE}),
hrefs AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']?((?:https?:)?//[^"''\\s>]+)', 1)) AS link FROM named),
pairs AS (SELECT src, {host("CASE WHEN starts_with(link, '//') THEN 'x:' || link ELSE link END")} AS dst, count(*) AS n FROM hrefs GROUP BY ALL),
links AS (SELECT * FROM pairs WHERE dst <> '' AND src <> '' AND src <> dst),
edges AS (SELECT 'trust' AS kind, src, dst, n FROM links UNION ALL SELECT 'distrust', dst, src, n FROM links),
step AS (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS p FROM edges),
walk AS (SELECT 0 AS round, kind, host, seed AS score FROM seeds UNION ALL SELECT * FROM (
  WITH flow AS (SELECT w.round, s.kind, s.dst AS host, {damping} * sum(w.score * s.p) AS score FROM walk w JOIN step s ON w.kind = s.kind AND w.host = s.src WHERE w.round < {rounds} GROUP BY ALL),
  back AS (SELECT round, kind, host, seed * (1 - coalesce((SELECT sum(score) FROM flow f WHERE f.kind = seeds.kind), 0)) AS score FROM seeds, (SELECT DISTINCT round FROM walk WHERE round < {rounds}))
  SELECT round + 1, kind, host, sum(score) FROM (FROM flow UNION ALL FROM back) GROUP BY ALL)),
verdicts AS (SELECT host, coalesce(sum(score) FILTER (kind = 'distrust'), 0) > {THRESHOLD} * sum(score) AS block FROM walk WHERE round = {rounds} GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(verdict, CASE WHEN coalesce(v.block, false) THEN 'block' ELSE 'allow' END) AS verdict FROM judged j LEFT JOIN verdicts v ON j.host = v.host
"""
