"""URL verdicts by redirect equivalence (operator 5), with DataFrame functions only.

A url's longest fitting rule decides. Urls without a rule take the method's verdict: redirect and canonical links
of the pages, relative ones too, are edges between urls (host, path and query, without scheme and fragment); in a connected component
a block decision reaches every alias without a rule, unless a member has an explicit allow, which takes precedence.
Everything else is allowed.

Null urls and urls without `://` have an empty host and path, and no links in or out. Null and empty html has no
links; html of any length is read whole. Repeated urls are one node; repeated pages are judged each. Of equally long
rules that fit, the one whose text is greatest wins. Other columns of pages are left aside, so their names cannot clash.
Columns come in the order page_id, host, path, rule, verdict. An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import discard, materialize
from corpuslens.llm.components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The rules of the query, as host, path, verdict.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: Up to so many rules are compared in place; more are joined by host suffix.
IN_PLACE = 500

HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
QUERY = r"(?s)^.*?://[^?#]*(\?[^#]*)"
CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
BASE_TAG = r"(?is)<base\b[^>]*\bhref\s*=[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)"
GOES_TO = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>;]+)"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"


def host_of(url: Column) -> Column:
    """Lower-cased (A-Z) host; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The node that a url stands for; null without `://`."""
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), path_of(url), F.coalesce(F.regexp_extract(url, QUERY, 1), F.lit(""))))


def resolve(base: Column, target: Column) -> Column:
    """The absolute url that a target on the page `base` means (RFC 3986); null for other schemes and without a base."""
    scheme, root = F.regexp_extract(base, r"(?s)^(.*?:)//", 1), F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    path = path_of(base)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1))
    rest = F.regexp_extract(target, r"(?s)([?#].*)$", 1)
    own = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    joined = F.when(own.startswith("/"), own).otherwise(F.concat(folder, own))
    relative = (
        F.when(target.startswith("?"), F.concat(root, path, target))
        .when(own == "", F.concat(F.regexp_extract(base, r"(?s)^([^#]*)", 1), target))
        .otherwise(F.concat(root, without_dots(joined), rest))
    )
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(F.instr(base, "://") == 0, F.lit(None).cast("string"))
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(~target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), relative)
    )


def without_dots(path: Column) -> Column:
    """A path that begins with `/`, its `.` and `..` segments carried out."""
    parts = F.split(path, "/")

    def step(kept: Column, x: Column) -> Column:
        return F.when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).when(x == ".", kept).otherwise(F.concat(kept, F.array(x)))

    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), step)
    open_end = F.element_at(parts, -1).isin(".", "..")
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.array_join(F.when(open_end, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")).otherwise(path)


def links_of(html: Column, url: Column) -> Column:
    """Targets of all canonical links and refreshes of a page, resolved against its url (or its base tag's)."""
    canonical = F.transform(F.regexp_extract_all(html, F.lit(CANONICAL), 0), lambda x: _attribute(x, HREF))
    refresh = F.transform(F.regexp_extract_all(html, F.lit(REFRESH), 0), lambda x: _attribute(x, GOES_TO))
    found = F.filter(F.concat(canonical, refresh), lambda x: x != "")
    tag = _attribute(F.regexp_extract(html, BASE_TAG, 0), HREF)
    base = F.when(tag != "", F.coalesce(resolve(url, tag), url)).otherwise(url)
    return F.filter(F.transform(found, lambda x: resolve(base, x)), lambda x: x.isNotNull())


def _attribute(tag: Column, pattern: str) -> Column:
    return F.replace(F.trim(F.regexp_extract(tag, pattern, 1)), F.lit("&amp;"), F.lit("&"))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(size, rule, verdict) of the longest rule that fits, or null."""
    table = F.array(*[F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(h).alias("h"), F.lit(p).alias("p")) for h, p, v in rules])
    fits = F.filter(table, lambda r: ((host == r["h"]) | host.endswith(F.concat(F.lit("."), r["h"]))) & path.startswith(r["p"]))
    return F.array_max(fits)


def with_rules(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """urls (with host, path) and rule, own: the longest rule that fits and its verdict, or nulls."""
    if not rules:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "own": F.lit(None).cast("string")})
    if len(rules) <= IN_PLACE:
        best = urls.withColumn("__best", longest_rule(F.col("host"), F.col("path"), rules))
        return best.withColumns({"rule": F.col("__best.rule"), "own": F.col("__best.verdict")}).drop("__best")
    table = urls.sparkSession.createDataFrame(rules, "suffix string, prefix string, verdict string")
    pairs = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fits = pairs.select("host", "path", F.explode(suffixes).alias("suffix")).join(table, "suffix").where(F.col("path").startswith(F.col("prefix")))
    rule = F.concat("suffix", "prefix")
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length(rule).alias("size"), rule.alias("rule"), "verdict")).alias("b"))
    return urls.join(best.select("host", "path", F.col("b.rule").alias("rule"), F.col("b.verdict").alias("own")), ["host", "path"], "left")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, host, path, rule, verdict of every page."""
    seen = with_rules(pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), node_of(F.col(url)).alias("node")), rules)
    links = pages.select(node_of(F.col(url)).alias("a"), F.explode(links_of(F.col(html), F.col(url))).alias("target")).where("a is not null")
    edges = materialize(links.select("a", node_of(F.col("target")).alias("b"), F.col("target").alias("b_url")).distinct())
    aliases = connected_components(edges)
    ends = edges.select(F.col("a").alias("node"), F.concat(F.lit("://"), "a").alias("u")).unionByName(edges.select(F.col("b").alias("node"), F.col("b_url").alias("u")))
    judged = with_rules(ends.select("node", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path")), rules).select("node", "own").distinct()
    member = materialize(aliases.join(judged, "node"))
    decided = member.groupBy("component").agg(F.max(F.expr("own = 'block'")).alias("blocked"), F.max(F.expr("own = 'allow'")).alias("allowed")).where("coalesce(blocked, false) and not coalesce(allowed, false)")
    spread = materialize(member.join(decided.select("component"), "component").select("node").distinct().withColumn("spread", F.lit("block")))
    discard(member)
    if spread.isEmpty():
        out = seen.withColumn("spread", F.lit(None).cast("string"))
    else:
        out = seen.join(spread, "node", "left")
    return out.select(key, "host", "path", "rule", F.coalesce("own", "spread", F.lit("allow")).alias("verdict"))
