"""URL verdicts by rules and by trust that flows over links between hosts, in Spark's own functions.

A rule names a host and a path and allows or blocks the urls of that host and its
subdomains whose path begins with the rule's; of several the longest holds, and of
two equally long ones that which blocks. Urls that no rule fits are judged by
their host.

Edges lead from a page's host to the hosts its anchors name, each page counting a
host once; relative links lead to the page's own host. Hosts are seeds by the share
of their pages that rules allow (trust) or block (distrust). Personalised PageRank
carries trust along the edges and distrust against them: a step keeps 0.15 of a
host's seed and hands on 0.85 of what each host holds, by the shares of its edges.
A host without links in a direction keeps what it holds. A host is blocked if its
distrust reaches ``threshold`` and is more than its trust. Steps go on until no host
changes by more than ``tolerance``.

Edges are counted before they meet, so a host with a third of all pages brings one
row per host it links to; ranks meet edges in hash joins, whose heavy keys Spark's
skew join splits. Every step is written to the shared folder.

Null or empty urls, and urls without ``://``, have neither host nor path and are
allowed; they are in no edge. Null html has no links. Repeated pages and a null
page_id are judged row by row, each counting as a page. Without rules every url is
allowed, and an empty table gives no rows. Long pages are read whole; an anchor
whose tag holds a ``<`` before its address is not read. Rules without a host are
left out, a null path is ``/``. Only the named columns are read, so extra ones cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, sized_broadcast, staged

FOLLOW = 0.85  # what a host hands on in a step
ANCHOR = r"""(?i)<a\s[^<>]*?href\s*=\s*["']?([^"'\s<>]*)"""
NAMES_HOST = r"^(?i)(https?:)?//[^/?#]"
OTHER_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path of a url; both empty without ``://``."""
    mark = F.instr(url, "://")
    rest = F.when(mark > 0, F.substr(url, mark + 3)).otherwise(F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def linked_hosts(html: Column, own: Column) -> Column:
    """The distinct hosts that a page's anchors lead to."""

    def led_to(link: Column) -> Column:
        named = lower_ascii(F.regexp_extract(link, "//([^/?#]*)", 1))
        return F.when(link.rlike(NAMES_HOST), named).when(link.rlike(OTHER_SCHEME), F.lit("")).otherwise(own)

    links = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(ANCHOR), F.lit(1))
    return F.array_remove(F.array_distinct(F.transform(links, led_to)), "")


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): the rules of each host and its parent domains, longest first."""
    rules = rules.filter("host IS NOT NULL").select(
        lower_ascii(F.col("host")).alias("parent"), F.coalesce("path", F.lit("/")).alias("path"), "allow"
    )
    rules = staged(rules.withColumn("rule", F.concat("parent", "path")), "url-rules")
    most = rules.agg(F.max(F.size(F.split("parent", r"\."))).alias("most")).first().most or 1
    labels = F.split("host", r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))),
        lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."),
    )
    rule = F.struct((-F.length("rule")).alias("order"), "allow", "rule", "path")
    return (
        hosts.select("host", F.explode(parents).alias("parent"))
        .join(sized_broadcast(rules), "parent")
        .groupBy("host")
        .agg(F.array_sort(F.collect_list(rule)).alias("rules"))
    )


def edges_of(urls: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst, share, back): what src hands on to dst of its trust, and of its distrust."""
    counted = staged(
        urls.filter("host != ''")
        .select(F.col("host").alias("src"), F.explode("targets").alias("dst"))
        .groupBy("src", "dst")
        .agg(F.count("*").cast("double").alias("n")),
        "host-edges",
    )

    def shares(src: str, dst: str, name: str) -> DataFrame:
        led = counted.select(F.col(src).alias("src"), F.col(dst).alias("dst"), "n")
        alone = hosts.select(F.col("host").alias("src")).join(led.select("src").distinct(), "src", "left_anti")
        led = led.union(alone.select("src", F.col("src").alias("dst"), F.lit(1.0)))
        whole = led.groupBy("src").agg(F.sum("n").alias("whole"))
        return led.join(whole, "src").select("src", "dst", (F.col("n") / F.col("whole")).alias(name))

    ahead, behind = shares("src", "dst", "share"), shares("dst", "src", "back")
    return staged(ahead.unionByName(behind, allowMissingColumns=True).fillna(0.0), "host-moves")


def propagated(edges: DataFrame, seeds: DataFrame, steps: int = 50, tolerance: float = 1e-6) -> DataFrame:
    """(host, trust, distrust) from seeds (host, good, bad)."""
    held = seeds.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust"))
    for _ in range(steps):
        came = (
            edges.join(held.withColumnRenamed("host", "src"), "src")
            .groupBy(F.col("dst").alias("host"))
            .agg(
                F.sum(F.col("trust") * F.col("share")).alias("led"), F.sum(F.col("distrust") * F.col("back")).alias("back")
            )
        )
        after = (
            seeds.join(held, "host")
            .join(came, "host", "left")
            .select(
                "host",
                (FOLLOW * F.coalesce("led", F.lit(0.0)) + (1 - FOLLOW) * F.col("good")).alias("trust"),
                (FOLLOW * F.coalesce("back", F.lit(0.0)) + (1 - FOLLOW) * F.col("bad")).alias("distrust"),
                F.col("trust").alias("was_trust"),
                F.col("distrust").alias("was_distrust"),
            )
        )
        after = staged(after, "host-ranks")
        change = F.greatest(F.abs(F.expr("trust - was_trust")), F.abs(F.expr("distrust - was_distrust")))
        held = after.select("host", "trust", "distrust")
        if (after.agg(F.max(change).alias("most")).first().most or 0.0) <= tolerance:
            break
    return held


def judge_urls(pages: DataFrame, rules: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per page page_id, host, path, rule (null if none fits), verdict, trust and distrust of the host.

    ``rules`` has columns host, path and allow.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    urls = staged(urls.select("page_id", "host", "path", linked_hosts(F.col("html"), F.col("host")).alias("targets")), "urls")
    own = urls.filter("host != ''").groupBy("host").agg(F.count("*").alias("pages"))
    by_host = sized_broadcast(staged(rules_by_host(own, rules).select("host", F.to_json("rules").alias("rules")), "host-rules"))
    kinds = "array<struct<order: int, allow: boolean, rule: string, path: string>>"
    fits = F.filter(F.from_json("rules", kinds), lambda r: F.col("path").startswith(r["path"]))
    judged = urls.join(by_host, "host", "left").withColumn("fit", F.try_element_at(fits, F.lit(1)))
    judged = staged(judged.select("page_id", "host", "path", "fit.rule", "fit.allow"), "judged-urls")
    seeds = judged.filter("host != ''").groupBy("host").agg(
        (F.count_if("allow") / F.count("*")).alias("good"), (F.count_if(~F.col("allow")) / F.count("*")).alias("bad")
    )
    only_linked = urls.filter("host != ''").select(F.explode("targets").alias("host")).distinct().join(own, "host", "left_anti")
    seeds = staged(seeds.union(only_linked.select("host", F.lit(0.0), F.lit(0.0))), "host-seeds")
    ranks = propagated(edges_of(urls, seeds), seeds)
    ranks = sized_broadcast(staged(ranks.join(own.select("host"), "host"), "host-verdicts"))
    blocked = (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))
    return judged.join(ranks, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.when(F.coalesce("allow", F.coalesce(~blocked, F.lit(True))), "allow").otherwise("block").alias("verdict"),
        "trust", "distrust",
    )
