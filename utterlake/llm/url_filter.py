"""URL filters: rules by host and path, and for urls without a rule a verdict of their host from the link graph.

All in DataFrame functions. Trust flows along links from hosts whose pages rules allow, distrust flows against them from
hosts whose pages rules block, each as a personalised PageRank without normalising, so that both have one scale: a host
all of whose pages are allowed starts with UNIT. A walk ends at a host without links. Ranks are integers, so a sum
doesn't depend on its order, and rounds end once nothing changes.

A link from a host to another is a name of that other host in a page's HTML, be it in the target of a link or in the
text (a footer's name, say). Each page counts a name once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed values of the contract.
RULES = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]
#: Rank of a host whose pages all have a rule's verdict, damping, rounds at most, and distrust per trust from which a host is blocked.
UNIT, DAMPING, ROUNDS, RATIO = 10**12, 0.85, 20, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: A dotted name; the look-behind only spares attempts to start inside a name.
NAME = r"(?<![A-Za-z0-9-])[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++(?::[0-9]+)?"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def suffixes(host: Column) -> Column:
    """A host and what it is a subdomain of."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def ruled(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """(id, host, path, rule, given) of every page: the longest rule that fits, of equally long ones the first by text, and its verdict."""
    spark = pages.sparkSession
    table = spark.createDataFrame([(r.host, r.path, r.text, r.verdict) for r in rules], "of string, prefix string, rule string, given string")
    each = pages.select("id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    hosts = each.select("host").where("host != ''").distinct().select("host", F.explode(suffixes(F.col("host"))).alias("of"))
    fits = hosts.join(table, "of").groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.length("rule")).alias("k"), "rule", "prefix", "given"))).alias("rules"))
    fits = written(fits.select(F.col("host").alias("h"), "rules"), "host-rules")
    best = F.element_at(F.filter("rules", lambda r: F.startswith(F.col("path"), r["prefix"])), 1)
    first = F.when(F.size(F.filter("rules", lambda r: F.startswith(F.col("path"), r["prefix"]))) > 0, best)
    return each.join(fits, F.col("host") == F.col("h"), "left").select("id", "host", "path", first["rule"].alias("rule"), first["given"].alias("given"))


def links(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst, n): pages of a host that name another host of the table."""
    named = pages.select(host(F.col("url")).alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(NAME), F.lit(0)), lambda x: F.translate(x, UPPER, LOWER)))).alias("dst"))
    pairs = named.where("src != '' and src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    return pairs.join(hosts.select(F.col("host").alias("dst")), "dst", "left_semi")


def ranks(judged: DataFrame, pages: DataFrame) -> DataFrame:
    """(host, trust, distrust) as a written table."""
    share = lambda v: F.floor(UNIT * (F.count_if(F.col("given") == v) / F.count("*"))).cast("long")
    seeds = written(judged.where("host != ''").groupBy("host").agg(share("allow").alias("t0"), share("block").alias("d0")), "host-seeds")
    edges = written(links(pages, seeds), "host-links")
    out_of, into = (edges.groupBy(F.col(c).alias("of")).agg(F.sum("n").alias("all")) for c in ("src", "dst"))
    forward = edges.join(out_of, edges["src"] == out_of["of"]).select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("n") / F.col("all")).alias("share"), F.lit(True).alias("trusts"))
    backward = edges.join(into, edges["dst"] == into["of"]).select(F.col("dst").alias("a"), F.col("src").alias("b"), (F.col("n") / F.col("all")).alias("share"), F.lit(False).alias("trusts"))
    moves = written(forward.union(backward), "host-moves")
    now = written(seeds.select("host", F.col("t0").alias("trust"), F.col("d0").alias("distrust")), "host-ranks")
    for _ in range(ROUNDS):
        given = F.floor(F.when(F.col("trusts"), F.col("trust")).otherwise(F.col("distrust")).cast("double") * DAMPING * F.col("share")).cast("long")
        got = moves.join(now, moves["a"] == now["host"]).groupBy("b").agg(F.sum(F.when(F.col("trusts"), given)).alias("t"), F.sum(F.when(~F.col("trusts"), given)).alias("d"))
        base = seeds.join(now, "host").join(got, F.col("host") == F.col("b"), "left")
        moved = [(F.floor(F.col(s).cast("double") * (1 - DAMPING)).cast("long") + F.coalesce(g, F.lit(0))) for s, g in (("t0", "t"), ("d0", "d"))]
        new = written(base.select("host", moved[0].alias("trust"), moved[1].alias("distrust"), F.col("trust").alias("t1"), F.col("distrust").alias("d1")), "host-ranks")
        still = not new.where("trust != t1 or distrust != d1").limit(1).count()
        drop_written(now)
        now = new
        if still:
            break
    for old in (edges, moves, seeds):
        drop_written(old)
    return now.select("host", "trust", "distrust")


def blocked(trust: Column, distrust: Column) -> Column:
    return distrust > RATIO * trust


def judge(pages: DataFrame, rules: list[Rule] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule or null, verdict, and the trust and distrust of the host.

    A rule fits its host and all subdomains where the path starts with the rule's. A url without a rule gets its host's
    verdict: block if its distrust exceeds RATIO times its trust. A host that no link reaches has only what rules say of
    its other pages, and without any of these is allowed, and so is a url without host (null, or no ``://``), whose
    ranks are 0. Null or empty HTML has no links. Repeated rows count each time. Other columns are ignored; an empty
    table gives no rows.
    """
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    judged = written(ruled(p, rules), "judged-urls")
    r = ranks(judged, p).select(F.col("host").alias("h"), "trust", "distrust")
    t, d = F.coalesce("trust", F.lit(0)), F.coalesce("distrust", F.lit(0))
    verdict = F.coalesce("given", F.when(blocked(t, d), "block").otherwise("allow"))
    return judged.join(r, F.col("host") == F.col("h"), "left").select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), t.alias("trust"), d.alias("distrust"))


def oracle(rules: list[Rule] = RULES) -> str:
    """The same in SQL, for DuckDB: each round is a step of its own."""
    table = ", ".join(f"('{r.host}', '{r.path}', '{r.text}', '{r.verdict}')" for r in rules)
    steps = ["k0 AS MATERIALIZED (SELECT host, t0 AS t, d0 AS d FROM s)"]
    for i in range(ROUNDS):
        given = "sum(CAST(floor(CAST({0} AS DOUBLE) * 0.85::DOUBLE * share) AS BIGINT))"
        steps.append(f"""k{i + 1} AS MATERIALIZED (SELECT s.host, CAST(floor(CAST(t0 AS DOUBLE) * (1::DOUBLE - 0.85::DOUBLE)) AS BIGINT) + coalesce(f.x, 0) AS t, CAST(floor(CAST(d0 AS DOUBLE) * (1::DOUBLE - 0.85::DOUBLE)) AS BIGINT) + coalesce(g.x, 0) AS d
  FROM s LEFT JOIN (SELECT dst AS h, {given.format("t")} AS x FROM fw JOIN k{i} ON src = host GROUP BY 1) f ON s.host = f.h
  LEFT JOIN (SELECT src AS h, {given.format("d")} AS x FROM bw JOIN k{i} ON dst = host GROUP BY 1) g ON s.host = g.h)""")
    return f"""WITH p AS MATERIALIZED (SELECT row_number() OVER () AS rn, page_id, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(rhost, rpath, rule, given) AS (VALUES {table}),
j AS MATERIALIZED (SELECT p.*, m.rule, m.given FROM p LEFT JOIN (SELECT * FROM (SELECT rn, rule, given, row_number() OVER (PARTITION BY rn ORDER BY -length(rule), rule) AS k
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) WHERE k = 1) m ON p.rn = m.rn),
s AS MATERIALIZED (SELECT host, CAST(floor({UNIT} * (count(*) FILTER (given = 'allow') / count(*))) AS BIGINT) AS t0, CAST(floor({UNIT} * (count(*) FILTER (given = 'block') / count(*))) AS BIGINT) AS d0 FROM j WHERE host != '' GROUP BY 1),
e AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, '[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+(?::[0-9]+)?'), lambda x: translate(x, '{UPPER}', '{LOWER}')))) AS dst FROM p)
  WHERE src != '' AND src != dst AND dst IN (SELECT host FROM s) GROUP BY 1, 2),
fw AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM e),
bw AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY dst) AS share FROM e),
{", ".join(steps)}
SELECT page_id, j.host, path, rule, coalesce(given, CASE WHEN coalesce(d, 0) > {RATIO} * coalesce(t, 0) THEN 'block' ELSE 'allow' END) AS verdict, CAST(coalesce(t, 0) AS BIGINT) AS trust, CAST(coalesce(d, 0) AS BIGINT) AS distrust
FROM j LEFT JOIN k{ROUNDS} k ON j.host = k.host"""
