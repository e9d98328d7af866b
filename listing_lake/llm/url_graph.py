"""URL filter by rules and by link-graph propagation, in DataFrame functions only.

A url's host and path meet the rules first: a rule holds for its host and all subdomains when the path starts with the
rule's; the longest rule wins. Hosts whose pages allow rules cover are trusted seeds, hosts whose pages block rules cover
are blocked seeds, each by its share of such pages. Over the host graph, trust is personalised PageRank along the edges,
and distrust the same against them. Edges are links from pages to other hosts, and those between a host and the host one
label up (``www.a.b`` and ``a.b``), both ways. Both go on until a few rounds change all scores together by ``tolerance`` at
most, of a total of one each; the damping bounds the number of rounds. A round keeps a part of each score where it is, which
ends the swing between a host and those one label up. A host of very many others is many rows in a round's join, which the
engine may split, and a sum that combines in each task before it is shuffled. Urls without a rule are blocked when their
host's distrust exceeds ``threshold`` times its trust and its plain share of pages together.

A null url or one without ``://`` has an empty host and path, and such urls are allowed when no rule holds. Null pages have
no links. Repeated rows count as often as they occur.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listing_lake.llm.common import whole, written

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The host and path of a url, and links to other hosts in a page.
URL = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
LINK = r"""(?i:href)\s*=\s*["']?(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(whole(url), URL, 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(whole(url), URL, 2)


def fitting(h: Column, p: Column, rules=RULES) -> Column:
    """The longest rule that holds, as struct<rule, verdict>; null if none does. A literal list of rules: its length is the
    plan's, not the data's."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((h == name) | h.endswith("." + name)) & p.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def parent(h: Column) -> Column:
    """The host one label up, while two labels are left; else null."""
    up = F.regexp_extract(h, r"^[^.]+\.(.+\..+)$", 1)
    return F.when(up != "", up)


def host_arcs(pages: DataFrame, url_col: str, html_col: str) -> tuple[DataFrame, DataFrame]:
    """Hosts with their page counts by rule, and weighted arcs between hosts. Links are combined by pair of hosts in the
    task that reads them, so a host with very many pages or links is a few rows when it is shuffled."""
    h, p = host(F.col(url_col)), path(F.col(url_col))
    rows = pages.select(h.alias("host"), fitting(h, p).alias("rule"))
    count = lambda v: F.sum((F.col("rule.verdict") == v).cast("long"))
    hosts = rows.filter("host <> ''").groupBy("host").agg(
        F.count("*").alias("n"), F.coalesce(count("allow"), F.lit(0)).alias("good"), F.coalesce(count("block"), F.lit(0)).alias("bad")
    )
    found = F.regexp_extract_all(whole(F.col(html_col)), F.lit(LINK), F.lit(1))
    links = pages.select(h.alias("src"), F.explode(found).alias("dst")).select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    links = links.filter("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("w"))
    up = hosts.select(F.col("host").alias("src"), parent(F.col("host")).alias("dst")).filter("dst IS NOT NULL")
    up = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("w", F.lit(1).cast("long"))
    edges = links.unionByName(up).groupBy("src", "dst").agg(F.sum("w").cast("double").alias("w"))
    return hosts, edges


def propagate(hosts: DataFrame, edges: DataFrame, *, damping: float = 0.85, tolerance: float = 1e-4, step: float = 0.7, cut: int = 4) -> DataFrame:
    """``host``, ``n``, ``trust`` and ``distrust``. Each round is one join of the arcs with the last scores and one sum by host;
    every ``cut`` rounds the scores are written, read again and compared. A host without arcs in one direction keeps its
    score. Only ``step`` of a score moves in a round: the limit is the same."""
    edges = written(edges, "url-edges")
    out = edges.groupBy("src").agg(F.sum("w").alias("total"))
    back = edges.groupBy("dst").agg(F.sum("w").alias("total"))
    ahead = edges.join(out, "src").select(F.col("src").alias("at"), F.col("dst").alias("to"), (F.col("w") / F.col("total")).alias("wt"), F.lit(0.0).alias("wd"))
    behind = edges.join(back, "dst").select(F.col("dst").alias("at"), F.col("src").alias("to"), F.lit(0.0).alias("wt"), (F.col("w") / F.col("total")).alias("wd"))
    every = edges.select(F.explode(F.array("src", "dst")).alias("host")).unionByName(hosts.select("host")).distinct()
    still = every.join(out.select(F.col("src").alias("host"), F.lit(0.0).alias("wt")), "host", "left").join(
        back.select(F.col("dst").alias("host"), F.lit(0.0).alias("wd")), "host", "left"
    )
    still = still.select(F.col("host").alias("at"), F.col("host").alias("to"), F.coalesce("wt", F.lit(1.0)).alias("wt"), F.coalesce("wd", F.lit(1.0)).alias("wd"))
    moves = ahead.unionByName(behind).unionByName(still).withColumns({w: F.col(w) * step * damping for w in ("wt", "wd")})
    stays = every.select(F.col("host").alias("at"), F.col("host").alias("to"), F.lit(1 - step).alias("wt"), F.lit(1 - step).alias("wd"))
    arcs = moves.unionByName(stays).groupBy("at", "to").agg(F.sum("wt").alias("wt"), F.sum("wd").alias("wd"))
    arcs = written(arcs, "url-arcs")
    total = hosts.agg(*(F.greatest(F.sum(c), F.lit(1)).alias(f"all_{c}") for c in ("n", "good", "bad")))  # one row
    seeds = every.join(hosts, "host", "left").na.fill(0, ["n", "good", "bad"]).join(F.broadcast(total))
    seeds = seeds.select("host", "n", (F.col("n") / F.col("all_n")).alias("share"), (F.col("good") / F.col("all_good")).alias("st"), (F.col("bad") / F.col("all_bad")).alias("sd"))
    seeds = written(seeds, "url-seeds")
    state = seeds.select("host", F.col("st").alias("t"), F.col("sd").alias("d"))
    for k in range(math.ceil(math.log(tolerance / 4) / math.log(1 - step * (1 - damping)) / cut) * cut):
        if k % cut == 0:
            before = state.select("host", F.col("t").alias("t0"), F.col("d").alias("d0"))
        flow = state.join(arcs, F.col("host") == F.col("at")).groupBy("to").agg(F.sum(F.col("t") * F.col("wt")).alias("ft"), F.sum(F.col("d") * F.col("wd")).alias("fd"))
        state = seeds.join(flow, F.col("host") == F.col("to"), "left").select(
            "host", (step * (1 - damping) * F.col("st") + F.coalesce("ft", F.lit(0.0))).alias("t"),
            (step * (1 - damping) * F.col("sd") + F.coalesce("fd", F.lit(0.0))).alias("d"),
        )
        if (k + 1) % cut == 0:
            state = written(state, "url-scores")
            change = state.join(before, "host").agg(F.sum(F.abs(F.col("t") - F.col("t0")) + F.abs(F.col("d") - F.col("d0")))).first()[0]
            if (change or 0) <= tolerance:
                break
    return seeds.join(state, "host").select("host", "n", "share", F.col("t").alias("trust"), F.col("d").alias("distrust"))


def judge(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = 1.0, **parameters) -> DataFrame:
    """One row per input row: the id, host, path, rule and verdict."""
    hosts, edges = host_arcs(pages, url_col, html_col)
    scores = propagate(hosts, edges, **parameters)
    bad = written(scores.filter(F.col("distrust") > threshold * (F.col("trust") + F.col("share"))).select(F.col("host").alias("_bad")), "url-bad")
    told = pages.select(F.col(id_col).alias(id_col), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    told = told.withColumn("_rule", fitting(F.col("host"), F.col("path")))
    told = told.join(bad, F.col("host") == F.col("_bad"), "left")
    method = F.when(F.col("_bad").isNotNull(), "block").otherwise("allow")
    return told.select(id_col, "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", method).alias("verdict"))


def _sql() -> str:
    case = lambda i: "CASE " + " ".join(
        f"WHEN (host = '{n}' OR ends_with(host, '.{n}')) AND starts_with(path, '{p}') THEN '{(n + p, v)[i]}'"
        for v, n, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r))
    ) + " END"
    link = LINK.replace("'", "''")
    rounds = []  # as many as leave less than the operator's tolerance
    for k in range(65):
        before = f"r{k - 1}" if k else "s"
        t, d = ("t", "d") if k else ("st", "sd")
        rounds.append(
            f"r{k} AS (SELECT s.host, 0.15 * st + 0.85 * coalesce(ft, 0) AS t, 0.15 * sd + 0.85 * coalesce(fd, 0) AS d FROM s LEFT JOIN "
            f"(SELECT a.dst, sum(b.{t} * wt) AS ft, sum(b.{d} * wd) AS fd FROM {before} b JOIN arcs a ON a.src = b.host GROUP BY a.dst) f ON s.host = f.dst)"
        )
    lower = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    return f"""
WITH p AS (SELECT page_id, html, {lower(f"regexp_extract(coalesce(url, ''), '{URL}', 1)")} AS host, regexp_extract(coalesce(url, ''), '{URL}', 2) AS path FROM pages),
q AS (SELECT *, {case(0)} AS rule, {case(1)} AS rule_verdict FROM p),
hosts AS (SELECT host, count(*) AS n, count(*) FILTER (rule_verdict = 'allow') AS good, count(*) FILTER (rule_verdict = 'block') AS bad FROM q WHERE host <> '' GROUP BY host),
links AS (SELECT host AS src, {lower("dst")} AS dst, count(*) AS w FROM (SELECT host, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS dst FROM p) u
  WHERE host <> '' AND dst <> '' AND host <> {lower("dst")} GROUP BY 1, 2),
up AS (SELECT host AS src, regexp_extract(host, '^[^.]+\\.(.+\\..+)$', 1) AS dst, 1 AS w FROM hosts),
edges AS (SELECT src, dst, sum(w)::DOUBLE AS w FROM (SELECT * FROM links UNION ALL SELECT * FROM up WHERE dst <> '' UNION ALL SELECT dst, src, w FROM up WHERE dst <> '') e GROUP BY 1, 2),
every AS (SELECT src AS host FROM edges UNION SELECT dst FROM edges UNION SELECT host FROM hosts),
arcs AS (SELECT src, dst, sum(wt) AS wt, sum(wd) AS wd FROM (
  SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS wt, 0.0 AS wd FROM edges
  UNION ALL SELECT dst, src, 0.0, w / sum(w) OVER (PARTITION BY dst) FROM edges
  UNION ALL SELECT host, host, CASE WHEN host IN (SELECT src FROM edges) THEN 0.0 ELSE 1.0 END, CASE WHEN host IN (SELECT dst FROM edges) THEN 0.0 ELSE 1.0 END FROM every) a GROUP BY 1, 2),
total AS (SELECT greatest(sum(n), 1) AS an, greatest(sum(good), 1) AS ag, greatest(sum(bad), 1) AS ab FROM hosts),
s AS (SELECT host, coalesce(n, 0) / an AS share, coalesce(good, 0) / ag AS st, coalesce(bad, 0) / ab AS sd FROM every LEFT JOIN hosts USING (host), total),
{", ".join(rounds)},
bads AS (SELECT s.host FROM s JOIN r64 USING (host) WHERE d > t + share)
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN host IN (SELECT host FROM bads) THEN 'block' ELSE 'allow' END) AS verdict FROM q
"""


ORACLE = _sql()
