"""URL filter: rules, and for pages without one, trust and distrust propagated over host links.

Rules judge what they fit. A host's share of pages that rules allow seeds its trust, the share
they block its distrust. Trust follows links forward and distrust backward (who links to blocked
hosts is suspect): two personalised PageRanks, r = (1 - d) seed + d * sum over links of share * r,
a host without links in that direction keeping what it has, until no rank moves by TOLERANCE.

The threshold is per host. A host with pages that rules judged stands on these: it is blocked if
distrust exceeds trust by THRESHOLD, each being the larger of seed and rank, so links to a blocked
host never clear it, and a host of which a few pages are blocked stays. Any other host is blocked
if distrust is more than THRESHOLD of all that reached it, and if its own links are evidence: a walk
along them, which goes on with chance d at each step, comes to blocked pages with more than chance
REACH. Neither thins out as a blocked host's linkers grow in number, though the distrust that each
of them gets does; one bad link among many hundreds is no evidence.

Links are absolute and protocol-relative href targets on another host, counted once a page. The
link table is summed to one row a pair of hosts before any walk; every round is two shuffles on
hosts, pre-summed, and is settled. Hosts never reach the driver.

Defined results: a null url, or one without ://, has an empty host and path, no rule, and is
allowed; a null html has no links; urls and pages of any length are read whole; a tie of trust and
distrust allows; a url on an unknown host is allowed; repeated rows give
repeated results and count each; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_ascii, picked, settled, small_side

#: (verdict, rule); the part of a rule before its first / is the host, the rest begins the path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
DAMPING, THRESHOLD, TOLERANCE, REACH = 0.85, 0.5, 1e-6, 1e-2
KINDS = {"trust": "trust", "distrust": "distrust", "reach": "distrust"}  # and what seeds each
#: A round moves ranks by DAMPING of what the round before did at most, so no more rounds are ever needed.
ROUNDS = math.ceil(math.log(TOLERANCE) / math.log(DAMPING)) + 1
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)\shref\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)"""
#: Hosts up to which their verdicts (some 50 bytes a row) are broadcast.
BROADCAST_HOSTS = 500_000


def parts(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    return fold_ascii(F.regexp_extract(u, URL, 1)), F.regexp_extract(u, URL, 2)


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    answer = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        answer = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(answer)
    return answer


def links(pages: DataFrame) -> DataFrame:
    """source, target, n: pages of one host that link to another. From columns host and html."""
    targets = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)), fold_ascii))
    out = pages.select(F.col("host").alias("source"), F.explode(F.filter(targets, lambda t: t != F.col("host"))).alias("target"))
    return out.where("source <> ''").groupBy("source", "target").agg(F.count("*").alias("n"))


def shares(pairs: DataFrame) -> DataFrame:
    """kind, source, target, share: trust along the links, distrust against them, reach against them by the linker's own links."""
    both = [pairs.select(F.lit(k).alias("kind"), F.col(a).alias("source"), F.col(b).alias("target"), F.col("source").alias("of") if own else F.col(a).alias("of"), "n") for k, a, b, own in (("trust", "source", "target", False), ("distrust", "target", "source", False), ("reach", "target", "source", True))]
    both = both[0].unionAll(both[1]).unionAll(both[2])
    out = both.groupBy("kind", "of").agg(F.sum("n").alias("all"))
    return both.join(out, ["kind", "of"]).select("kind", "source", "target", (F.col("n") / F.col("all")).alias("share"))


def propagated(seeds: DataFrame, pairs: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """host, trust, distrust, reach from seeds (host, trust, distrust) and link counts."""
    pairs = settled(pairs)
    if pairs.isEmpty():
        return seeds.withColumn("reach", F.col("distrust"))  # nothing moves
    flows = settled(shares(pairs))
    hosts = flows.select(F.col("source").alias("host")).union(seeds.select("host")).distinct()
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(seed, F.lit(0.0)).alias("seed")) for k, seed in KINDS.items()])).alias("k")
    ends = flows.select("kind", F.col("source").alias("host")).distinct().withColumn("flows", F.lit(True))
    rank = hosts.join(seeds, "host", "left").select("host", kinds).select("host", "k.kind", "k.seed").join(ends, ["kind", "host"], "left")
    rank = settled(rank.select("kind", "host", "seed", F.coalesce("flows", F.lit(False)).alias("flows"), F.col("seed").alias("r"), F.lit(1.0).alias("moved")))
    for _ in range(rounds):
        got = flows.join(rank.select("kind", F.col("host").alias("source"), "r"), ["kind", "source"]).groupBy("kind", F.col("target").alias("host")).agg(F.sum(F.col("share") * F.col("r")).alias("got"))
        inflow, kept = F.coalesce("got", F.lit(0.0)), F.when(F.col("flows"), 0.0).otherwise(F.col("r"))
        new = F.when(F.col("kind") == "reach", F.col("seed") + (1 - F.col("seed")) * damping * inflow).otherwise((1 - damping) * F.col("seed") + damping * (inflow + kept))
        rank = settled(rank.join(got, ["kind", "host"], "left").select("kind", "host", "seed", "flows", new.alias("r"), F.abs(new - F.col("r")).alias("moved")))
        if rank.agg(F.max("moved")).first()[0] < TOLERANCE:
            break
    return rank.groupBy("host").agg(*[F.sum(F.when(F.col("kind") == k, F.col("r"))).alias(k) for k in KINDS])


def blocked(threshold: float = THRESHOLD) -> Column:
    """Whether a host with trust, distrust and reach and seeds _t and _d is blocked."""
    t, d = F.greatest("trust", F.coalesce("_t", F.lit(0.0))), F.greatest("distrust", F.coalesce("_d", F.lit(0.0)))
    seeded = F.coalesce(F.col("_t") + F.col("_d"), F.lit(0.0)) > 0
    return F.when(seeded, d - t > threshold).otherwise((F.col("reach") > REACH) & (d > threshold * (d + t)))


def judged(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, **walk) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages (page_id, url, html)."""
    pages = picked(pages, "page_id", "url", "html")
    host, path = parts(F.col("url"))
    p = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    p = p.withColumn("_r", ruled(F.col("host"), F.col("path"), rules))
    is_ = lambda v: F.avg(F.when(F.col("_r.verdict") == v, 1.0).otherwise(0.0))
    seeds = p.where("host <> ''").groupBy("host").agg(is_("allow").alias("trust"), is_("block").alias("distrust"))
    seeds = settled(seeds)
    own = seeds.select("host", F.col("trust").alias("_t"), F.col("distrust").alias("_d"))
    scores = propagated(seeds, links(p), **walk).join(own, "host", "left")
    verdicts = settled(scores.select("host", blocked(threshold).alias("_blocked")))
    out = p.drop("html").join(small_side(verdicts, BROADCAST_HOSTS), "host", "left")
    method = F.when(F.col("_blocked"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce("_r.verdict", method).alias("verdict"))


def _oracle() -> str:
    fits = "((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}'))"
    cases = [(v, r, fits.format(h=r.partition("/")[0], p=r.partition("/")[2])) for v, r in sorted(RULES, key=lambda r: -len(r[1]))]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r}'" for _, r, f in cases) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for v, _, f in cases) + " END"
    link = LINK.replace("'", "''")
    sql = f"""WITH u AS (SELECT page_id, html, COALESCE(url, '') AS url FROM pages),
h AS (SELECT page_id, html, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM u),
p AS (SELECT *, {rule} AS rule, {verdict} AS ruled FROM h),
s AS MATERIALIZED (SELECT host, AVG(CASE WHEN ruled = 'allow' THEN 1.0 ELSE 0.0 END) AS trust, AVG(CASE WHEN ruled = 'block' THEN 1.0 ELSE 0.0 END) AS distrust FROM p WHERE host <> '' GROUP BY host),
t AS (SELECT DISTINCT page_id, host AS source, lower(unnest(regexp_extract_all(COALESCE(html, ''), '{link}', 1))) AS target FROM p WHERE host <> ''),
n AS (SELECT source, target, COUNT(*) AS n FROM t WHERE source <> target GROUP BY source, target),
b AS (SELECT 'trust' AS kind, source, target, source AS own, n FROM n UNION ALL SELECT 'distrust', target, source, target, n FROM n UNION ALL SELECT 'reach', target, source, source, n FROM n),
f AS MATERIALIZED (SELECT kind, source, target, n / SUM(n) OVER (PARTITION BY kind, own) AS share FROM b),
r0 AS MATERIALIZED (SELECT k.kind, a.host, COALESCE(CASE k.kind WHEN 'trust' THEN s.trust ELSE s.distrust END, 0.0) AS seed, COALESCE(CASE k.kind WHEN 'trust' THEN s.trust ELSE s.distrust END, 0.0) AS r,
  EXISTS (SELECT 1 FROM f WHERE f.kind = k.kind AND f.source = a.host) AS flows
  FROM (SELECT host FROM s UNION SELECT source FROM f) a CROSS JOIN (SELECT unnest(['trust', 'distrust', 'reach']) AS kind) k LEFT JOIN s ON s.host = a.host),
"""
    for i in range(1, ROUNDS + 1):
        sql += f"r{i} AS MATERIALIZED (SELECT r.kind, r.host, r.seed, CASE r.kind WHEN 'reach' THEN r.seed + (1 - r.seed) * {DAMPING} * COALESCE(g.got, 0.0) ELSE {1 - DAMPING!r}::DOUBLE * r.seed + {DAMPING} * (COALESCE(g.got, 0.0) + CASE WHEN r.flows THEN 0.0 ELSE r.r END) END AS r, r.flows FROM r{i - 1} r LEFT JOIN (SELECT f.kind, f.target AS host, SUM(f.share * q.r) AS got FROM f JOIN r{i - 1} q ON q.kind = f.kind AND q.host = f.source GROUP BY f.kind, f.target) g ON g.kind = r.kind AND g.host = r.host),\n"
    return sql + f"""e AS (SELECT host, MAX(CASE WHEN kind = 'trust' THEN GREATEST(r, seed) END) AS t, MAX(CASE WHEN kind = 'distrust' THEN GREATEST(r, seed) END) AS d, MAX(CASE WHEN kind = 'reach' THEN r END) AS reach, SUM(seed) > 0 AS seeded FROM r{ROUNDS} GROUP BY host),
v AS (SELECT host, CASE WHEN seeded THEN d - t > {THRESHOLD} ELSE reach > {REACH} AND d > {THRESHOLD} * (d + t) END AS blocked FROM e)
SELECT p.page_id, p.host, p.path, p.rule, COALESCE(p.ruled, CASE WHEN v.blocked THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN v ON v.host = p.host"""


ORACLE = _oracle()
