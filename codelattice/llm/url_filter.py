"""Operator 10: URL rules with redirect equivalence.

A rule names a host and a path prefix; it fits the host and its subdomains,
and the longest fitting rule decides. Pages without a rule of their own can
still be aliases of ruled ones: redirects (``<meta http-equiv=refresh>`` and,
where the table has it, a ``redirect`` column) and canonical links join URLs
to components, found by distributed connected components, and a block of one
member reaches the members that no rule decides. Explicit allow has
precedence twice: a page's own rule always stands, and in a component that
also holds an explicitly allowed URL the undecided members are allowed.

Nodes are 128-bit digests of URLs without fragment. Only URLs that have an
edge enter the component search.

Defined results. A null URL, or one without ``://``, has empty host and path,
fits no rule and has no edges: allow. Repeated pages are judged alike. Link
targets that are no page are judged by the rules as well. Pages without html
have no edges. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import connected_components

#: (verdict, host, path): the rules of the contract.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after(url: Column) -> Column:
    """What follows the first ``://``; null if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(rule_host: str, rule_path: str, host: Column, path: Column) -> Column:
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule name, verdict) of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = _fits(h, p, host, path)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _attribute(tag: Column, name: str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(tag, rf'(?i)\b{name}\s*=\s*"([^"]*)"', 1), F.lit("")), F.nullif(F.regexp_extract(tag, rf"(?i)\b{name}\s*=\s*'([^']*)'", 1), F.lit("")), F.nullif(F.regexp_extract(tag, rf"(?i)\b{name}\s*=\s*([^\s\"'>]+)", 1), F.lit("")))


def _absolute(link: Column, url: Column) -> Column:
    """``link`` as seen from ``url``."""
    scheme, origin = F.regexp_extract(url, r"^([^:]*):", 1), F.regexp_extract(url, r"^([^:]*://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"^([^:]*://[^/?#]*/(?:[^?#]*/)?)", 1)
    base = F.when(folder == "", F.concat(origin, F.lit("/"))).otherwise(folder)
    return F.when(link.contains("://"), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link)).when(link.startswith("/"), F.concat(origin, link)).when((link == "") | link.startswith("#"), F.lit(None)).otherwise(F.concat(base, link))


def alias_edges(pages: DataFrame) -> DataFrame:
    """(url, alias): canonical links, refresh redirects and ``redirect`` values."""
    html = F.col("html").cast("string")
    canonical = F.transform(F.filter(F.regexp_extract_all(html, F.lit(r"(?i)(<link\b[^>]*>)"), F.lit(1)), lambda t: t.rlike(r"(?i)\brel\s*=\s*[\"']?canonical\b")), lambda t: _attribute(t, "href"))
    refresh = F.transform(F.filter(F.regexp_extract_all(html, F.lit(r"(?i)(<meta\b[^>]*>)"), F.lit(1)), lambda t: t.rlike(r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b")), lambda t: F.nullif(F.regexp_extract(t, r"(?i)url\s*=\s*['\"]?([^\"'>\s]+)", 1), F.lit("")))
    links = F.concat(F.coalesce(canonical, F.array().cast("array<string>")), F.coalesce(refresh, F.array().cast("array<string>")))
    if "redirect" in pages.columns:
        links = F.concat(links, F.array(F.col("redirect").cast("string")))
    has = F.col("url").contains("://") & (html.rlike(r"(?i)<(link|meta)\b[^>]*(canonical|refresh)") | (F.col("redirect").isNotNull() if "redirect" in pages.columns else F.lit(False)))
    found = pages.filter(has).select(F.col("url").cast("string").alias("url"), F.explode(links).alias("link")).filter("link is not null")
    return found.select(_bare(F.col("url")).alias("url"), _bare(_absolute(F.col("link"), F.col("url"))).alias("alias")).filter("alias is not null and url != alias").distinct()


def _bare(url: Column) -> Column:
    return F.regexp_replace(url, r"#.*$", "")


def judge(pages: DataFrame, rules=RULES, edges: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, component for each row of ``pages``.

    ``edges`` (url, alias) come beside those found in the pages.
    """
    url = F.col("url").cast("string")
    host, path = host_of(url), path_of(url)
    rule, own = rule_of(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", url.alias("url"), host.alias("host"), path.alias("path")).withColumn("rule", rule).withColumn("own", own)
    links = alias_edges(pages)
    if edges is not None:
        links = links.unionByName(edges.select(_bare(F.col("url").cast("string")).alias("url"), _bare(F.col("alias").cast("string")).alias("alias")))
    links = cut(links, "aliases")
    node = lambda c: F.md5(c)
    roots = connected_components(links.select(node(F.col("url")).alias("a"), node(F.col("alias")).alias("b")))
    named = links.select("url").unionByName(links.select(F.col("alias").alias("url"))).distinct().withColumn("node", node(F.col("url")))
    named = named.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).withColumn("own", own)
    members = roots.join(named, "node", "left")
    verdicts = members.groupBy("root").agg(F.max(F.col("own") == "allow").alias("allowed"), F.max(F.col("own") == "block").alias("blocked"))
    by_node = cut(roots.join(verdicts, "root").select("node", F.col("root").alias("component"), (F.coalesce("blocked", F.lit(False)) & ~F.coalesce("allowed", F.lit(False))).alias("reached")), "reached")
    out = judged.withColumn("node", F.when(F.col("url").contains("://"), node(_bare(F.col("url")))))
    out = out.join(by_node, "node", "left")
    verdict = F.coalesce("own", F.when(F.col("reached"), F.lit("block")), F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "component")
