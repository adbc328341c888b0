"""URL filters: rules first, then trust and distrust propagated over the link graph of hosts.

Rules name a host and a path. Hosts with pages that a rule allows are trusted seeds, hosts with
pages that a rule blocks are blocked seeds, each by the share of its pages. Trust follows links,
distrust goes against them, from a page's target to its source: both are personalised PageRank
over host edges, a join and an aggregate for each step. A page without a rule is blocked if its
host's distrust reaches the threshold and exceeds its trust. A host alone with all its pages
blocked has distrust 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import stored

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Steps end when what is left to hand on is under this share of what the seeds began with.
DAMPING, LEFT, THRESHOLD = 0.85, 1e-4, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_HREF = r"""(?is)(?:\s|["'])href\s*=\s*["']?\s*([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as text) and its verdict; both null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """Edges (src, dst, pages) between different hosts, by absolute links; ``pages`` has host and html."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1)))).alias("href"))
    whole = F.when(F.startswith("href", F.lit("//")), F.concat(F.lit("http:"), "href")).otherwise(F.col("href"))
    absolute = links.where(F.col("href").rlike("^([A-Za-z][A-Za-z0-9+.-]*:)?//")).select("src", host_of(whole).alias("dst"))
    return absolute.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("pages"))


def propagate(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Rows (host, trust, distrust); ``seeds`` has host, trusted and blocked, shares from 0 to 1.

    Weight that reaches a host without further edges stays there. All that a step hands on is
    added, and steps end when its sum, over all hosts, is under ``LEFT`` of the seeds' own: it shrinks by
    ``DAMPING`` a step at least, so that is after 57 steps at most, whatever the graph's size.
    """
    both = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("at"), F.col("dst").alias("to"), "pages").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("at"), F.col("src").alias("to"), "pages")
    )
    total = both.groupBy("kind", "at").agg(F.sum("pages").alias("total"))
    flow = stored(both.join(total, ["kind", "at"]).select("kind", "at", "to", (F.col("pages") / F.col("total")).alias("share")), "host-flow")
    start = seeds.select("host", F.explode(F.create_map(F.lit("trust"), F.col("trusted"), F.lit("distrust"), F.col("blocked"))).alias("kind", "value")).where("value > 0")
    fresh = total = stored(start.select("kind", "host", F.col("value").cast("double").alias("value")), "host-rank")
    least = LEFT * (fresh.agg(F.sum("value")).first()[0] or 0)
    while True:
        moved = fresh.join(flow, (fresh["kind"] == flow["kind"]) & (fresh["host"] == flow["at"])).groupBy(flow["kind"], F.col("to").alias("host")).agg(F.sum(F.col("value") * F.col("share") * DAMPING).alias("value"))
        fresh = stored(moved, "host-rank")
        left = fresh.agg(F.sum("value")).first()[0]
        if not left:
            break
        total = total.unionByName(fresh)
        if left * DAMPING <= least:
            break
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("value"))), F.lit(0.0))
    return total.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A row per page: page_id, host, path, rule, verdict, trust, distrust.

    A url that is null or has no ``://`` has an empty host and path, no rule and no links' weight:
    it is allowed. Null html has no links; html is searched whole, however long. Rows that repeat count as
    pages of their own and are judged alike. Two rules of one length that both fit are one text; of
    a rule given twice the later verdict holds. Other columns are not read; an empty table gives no rows.
    """
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    own = own.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    ruled = own.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), "html")
    share = lambda what: F.avg(F.when(F.col("ruled") == what, 1.0).otherwise(0.0))
    seeds = ruled.where("host <> ''").groupBy("host").agg(share("allow").alias("trusted"), share("block").alias("blocked"))
    ranks = propagate(host_edges(ruled), seeds)
    joined = ruled.drop("html").join(ranks, "host", "left").na.fill(0.0, ["trust", "distrust"])
    bad = (F.col("distrust") >= THRESHOLD) & (F.col("distrust") > F.col("trust"))
    return joined.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
