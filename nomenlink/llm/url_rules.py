"""URL filter: host and path rules, carried over redirects and canonical links.

URLs that redirect to one another, or name one another as canonical, are one
page. Links form a graph whose connected components are computed in parallel;
a block decision reaches every alias, unless an alias is explicitly allowed.
A rule that fits a URL itself always decides for it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nomenlink.llm.components import components
from nomenlink.llm.scratch import Scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the query.
RULES = (
    UrlRule("block", "net", "/"),
    UrlRule("allow", "example.net", "/en/"),
    UrlRule("block", "example.com", "/de/"),
    UrlRule("allow", "org", "/fr/"),
)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """A URL as a node: without scheme and fragment, host lowered."""
    tail = F.regexp_extract(_rest(url), "^[^/?#]*([^#]*)", 1)
    return F.concat(host_of(url), F.when(tail == "", "/").otherwise(tail))


def fitting_rule(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # The last one to fit wins; allow comes after block at equal length.
    for rule in sorted(rules, key=lambda r: (len(r.name), r.verdict == "allow")):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def _resolved(base: Column, link: Column) -> Column:
    """A link as an absolute URL."""
    scheme = F.substring_index(base, "://", 1)
    root = F.concat(scheme, F.lit("://"), F.regexp_extract(_rest(base), "^[^/?#]*", 0))
    folder = F.regexp_replace(F.when(path_of(base) == "", "/").otherwise(path_of(base)), "[^/]*$", "")
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(root, folder, link))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """``from_url`` and ``to_url`` of canonical links and immediate redirects in the pages' html."""
    # What is commented out, or the text of an element that holds no markup, links nowhere.
    dead = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title|template|xmp)\b.*?(?:</\1\s*>|\z)"
    tag = r"""(?is)<{}(?=[\s/])(?:[^>"']|"[^"]*"|'[^']*')*>"""
    quoted = r"""(?is)(?<=[\s"'/]){}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""

    def attribute(source: Column, name: str) -> Column:
        parts = [F.regexp_extract(source, quoted.format(name), k) for k in (1, 2, 3)]
        return F.regexp_replace(F.trim(F.concat(*parts)), "&amp;", "&")

    marked = pages.where("url is not null and html is not null").where(
        F.col("html").rlike("(?i)canonical|refresh")
    )
    marked = marked.select("url", F.regexp_replace("html", dead, " ").alias("html"))
    links = marked.select("url", F.explode(F.regexp_extract_all("html", F.lit(tag.format("link")), 0)).alias("tag"))
    links = links.where(F.array_contains(F.split(F.lower(attribute(F.col("tag"), "rel")), r"\s+"), "canonical"))
    metas = marked.select("url", F.explode(F.regexp_extract_all("html", F.lit(tag.format("meta")), 0)).alias("tag"))
    metas = metas.where(F.lower(attribute(F.col("tag"), "http-equiv")) == "refresh")
    target = F.regexp_extract(attribute(F.col("tag"), "content"), r"(?i)url\s*=\s*['\"]?([^'\"]+)", 1)
    found = links.select("url", attribute(F.col("tag"), "href").alias("link")).union(
        metas.select("url", F.trim(target).alias("link"))
    )
    found = found.where("link <> '' and instr(url, '://') > 0")
    return found.select(F.col("url").alias("from_url"), _resolved(F.col("url"), F.col("link")).alias("to_url"))


def judge_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` of every page.

    Reads ``page_id``, ``url`` and ``html``, and ``from_url`` and ``to_url`` of
    ``redirects``; other columns are ignored, whatever their names. Without a
    fitting rule, a page is allowed if an alias is explicitly allowed, blocked
    if none is but one is blocked, and allowed otherwise.

    A null URL or one without ``://`` has empty host and path, no rule and no
    alias. Null html has no links; a null ``page_id`` stays null; rows that
    repeat are all returned; links to pages not in the table count, as their
    URLs are judged too. No rows give no rows.
    """
    scratch = Scratch(pages.sparkSession, "url-rules")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select(
        "page_id",
        F.coalesce(host, F.lit("")).alias("host"),
        F.coalesce(path, F.lit("")).alias("path"),
        F.when(F.instr("url", "://") > 0, F.xxhash64(node_of(F.col("url")))).alias("node"),
    )
    rule, own = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = judged.withColumns({"rule": rule, "own": own})

    links = page_links(pages)
    if redirects is not None:
        known = "instr(from_url, '://') > 0 and instr(to_url, '://') > 0"
        links = links.union(redirects.select("from_url", "to_url").where(known))
    links = scratch.keep(links, "links")
    if links.isEmpty():
        verdict = F.coalesce("own", F.lit("allow")).alias("verdict")
        return judged.select("page_id", "host", "path", "rule", verdict)

    nodes = links.select(F.explode(F.array("from_url", "to_url")).alias("url"))
    _, verdict = fitting_rule(host_of(F.col("url")), path_of(F.col("url")), rules)
    nodes = nodes.select(F.xxhash64(node_of(F.col("url"))).alias("node"), verdict.alias("own")).distinct()
    ends = [F.xxhash64(node_of(F.col(c))).alias(name) for c, name in (("from_url", "a"), ("to_url", "b"))]
    roots = components(links.select(*ends), scratch, "aliases")
    member = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = member.groupBy("root").agg(F.min("own").alias("spread"))  # allow sorts before block
    spread = scratch.keep(member.select("node", "root").distinct().join(groups, "root").drop("root"), "spread")
    verdict = F.coalesce("own", "spread", F.lit("allow")).alias("verdict")
    return judged.join(spread, "node", "left").select("page_id", "host", "path", "rule", verdict)


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict for every page."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
