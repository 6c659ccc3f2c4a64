"""URL filters whose decisions follow redirects and canonical links, all in DataFrame functions.

A rule names a host, with its subdomains, and a path prefix; the longest that fits decides. Where none fits, the url's
aliases do: connected components over redirect and canonical-link edges take an explicit allow of any member first, then
a block; with neither the url is allowed.

Urls are the same node when they differ in the case of scheme and host, a default port, dot segments, an empty path and
``/``, or the fragment. Links count outside comments and scripts only; all canonical links of a page do; entities are
resolved, and ``<base href>`` is what relative links stand on.

Null urls and urls without ``://`` have empty host and path and are allowed; repeated rows are judged one by one; pages
without html, or with empty one, give no edge; very long html is read whole; rules of equal length go by their pattern;
other columns of the input are ignored, whatever their names; an empty table gives no row.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .components import components

#: So many rules become one CASE expression in every task; more of them are a table that urls are joined with.
FEW_RULES = 200
_TAG = r"(?is)<{}\b[^>]*>"
_ATTRIBUTE = r"(?is)(?<![\w-]){}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
_UNSEEN = r"(?is)<!--.*?(?:-->|$)|<script\b.*?(?:</script\s*>|$)"
# Entities that urls need.
_ENTITIES = ((r"&quot;|&#34;|&#[xX]22;", '"'), (r"&apos;|&#39;|&#[xX]27;", "'"), (r"&#47;|&#[xX]2[fF];", "/"), (r"&amp;|&#38;|&#[xX]26;", "&"))


@dataclass(frozen=True)
class UrlRule:
    """``pattern``: host and path prefix, like ``example.net/en/``; ``verdict``: allow or block."""

    pattern: str
    verdict: str

    def fits(self, host: Column, path: Column) -> Column:
        name, _, rest = self.pattern.partition("/")
        return ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased, and path; both empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    part = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return lower_ascii(F.regexp_extract(url, part, 1)), F.regexp_extract(url, part, 2)


def decide(host: Column, path: Column, rules: list[UrlRule]) -> tuple[Column, Column]:
    """Pattern and verdict of the longest rule that fits; null where none does."""
    ordered = sorted(rules, key=lambda r: (-len(r.pattern), r.pattern))
    none = F.lit(None).cast("string")
    chain = lambda value: reduce(lambda rest, r: F.when(r.fits(host, path), value(r)).otherwise(rest), ordered[::-1], none)
    return chain(lambda r: r.pattern), chain(lambda r: r.verdict)


def suffixes(host: Column) -> Column:
    """The host and all domains above it."""
    names = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "."))


def decide_by_table(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` (host, path, ...) with ``rule`` and ``ruled``, as ``decide`` gives them, of a table of rules (pattern, verdict) of any size; of
    rules that repeat a pattern an allow counts.

    Each url asks for its host's domains, then for the beginnings of its path that are as long as some rule of that domain, and those
    keys meet the rules: no url is compared with the rules of a domain one by one."""
    name = F.substring_index("pattern", "/", 1)
    rest = F.when(F.contains("pattern", F.lit("/")), F.expr("substring(pattern, length(substring_index(pattern, '/', 1)) + 2)")).otherwise("")
    keyed = rules.groupBy("pattern").agg(F.min("verdict").alias("verdict"))
    keyed = keyed.select("pattern", "verdict", name.alias("name"), F.concat(F.lit("/"), rest).alias("start"))
    lengths = keyed.groupBy("name").agg(F.array_sort(F.collect_set(F.length("start"))).alias("lengths"))
    asked = rows.select("host", "path").distinct()
    asked = asked.select("host", "path", F.explode(suffixes(F.col("host"))).alias("name")).join(lengths, "name")
    fitting = F.filter("lengths", lambda n: n <= F.length("path"))
    asked = asked.select("host", "path", "name", F.explode(F.transform(fitting, lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("start"))
    met = asked.join(keyed, ["name", "start"])
    best = F.min_by(F.struct(F.col("pattern").alias("rule"), F.col("verdict").alias("ruled")), F.struct(-F.length("pattern"), "pattern"))
    found = met.groupBy("host", "path").agg(best.alias("_b")).select("host", "path", "_b.rule", "_b.ruled")
    return rows.join(found, ["host", "path"], "left")


def judged(rows: DataFrame, rules: list[UrlRule] | DataFrame) -> DataFrame:
    """``rows`` (host, path, ...) with ``rule`` and ``ruled``: few rules in the plan, many as a table."""
    if isinstance(rules, DataFrame):
        return decide_by_table(rows, rules)
    if len(rules) > FEW_RULES:
        return decide_by_table(rows, rows.sparkSession.createDataFrame([(r.pattern, r.verdict) for r in rules], "pattern string, verdict string"))
    rule, verdict = decide(F.col("host"), F.col("path"), rules)
    return rows.withColumns({"rule": rule, "ruled": verdict})


def _without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments resolved; others are not looked at."""
    parts = F.split(F.substring(path, F.lit(2), F.length(path)), "/")

    def add(done: Column, part: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), add)
    folder = F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0)
    resolved = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(folder, "/").otherwise(""))
    return F.when(path.startswith("/") & path.contains("/."), resolved).otherwise(path)


def node_of(url: Column) -> Column:
    """A url without fragment, default port and dot segments, its scheme and host lower-cased, its path ``/`` at least."""
    part = r"(?s)^(.*?://)([^/?#]*)([^?#]*)(\?[^#]*)?"
    scheme, host, path = (F.regexp_extract(url, part, n) for n in (1, 2, 3))
    scheme, host = lower_ascii(scheme), lower_ascii(host)
    host = (
        F.when(scheme == "http://", F.regexp_replace(host, ":(80)?$", ""))
        .when(scheme == "https://", F.regexp_replace(host, ":(443)?$", ""))
        .otherwise(host)
    )
    path = F.when(path == "", "/").otherwise(_without_dots(path))
    return F.when(scheme != "", F.concat(scheme, host, path, F.regexp_extract(url, part, 4)))


def absolute(link: Column, base: Column) -> Column:
    """A link as it stands on page ``base``: whole, without scheme, from the root, of the same path, or beside the page."""
    scheme, root = F.regexp_extract(base, r"(?s)^(.*?:)//", 1), F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    page = F.regexp_extract(base, r"(?s)^(.*?://[^?#]*)", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(page, link))
        .when(link.startswith("#"), base)
        .when(link != "", F.concat(folder, F.when(folder.endswith("/"), "").otherwise("/"), link))
    )


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value, trimmed and with its entities resolved; empty where it is missing."""
    value = F.concat(*[F.regexp_extract(tag, _ATTRIBUTE.format(name), n) for n in (1, 2, 3)])
    for entity, char in _ENTITIES:
        value = F.regexp_replace(value, entity, char)
    return F.trim(F.regexp_replace(value, r"^\s+|\s+$", ""))


def _tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(_TAG.format(name)), F.lit(0))


def page_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) of each page's canonical links and of its refresh redirects."""
    html = F.lower(F.coalesce("html", F.lit("")))
    some = pages.where(F.col("url").isNotNull() & (F.contains(html, F.lit("canonical")) | F.contains(html, F.lit("http-equiv"))))
    seen = some.select("url", F.regexp_replace("html", _UNSEEN, " ").alias("seen"))
    canonical = F.filter(
        _tags(F.col("seen"), "link"), lambda t: F.array_contains(F.split(F.lower(_attribute(t, "rel")), r"\s+"), "canonical")
    )
    refresh = F.filter(_tags(F.col("seen"), "meta"), lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh")
    target = lambda t: F.regexp_extract(_attribute(t, "content"), r"(?is)^[\s\d.]*[;,]?\s*url\s*=\s*[\"']?([^\"']*)", 1)
    links = F.concat(F.transform(canonical, lambda t: _attribute(t, "href")), F.transform(refresh, target))
    bases = F.filter(F.transform(_tags(F.col("seen"), "base"), lambda t: _attribute(t, "href")), lambda x: x != "")
    found = seen.select("url", links.alias("links"), F.get(bases, 0).alias("base")).where(F.size("links") > 0)
    found = found.select("url", F.coalesce(absolute(F.col("base"), F.col("url")), "url").alias("base"), F.explode("links").alias("link"))
    found = found.select(
        node_of(F.col("url")).alias("src"), node_of(absolute(F.trim("link"), F.col("base"))).alias("dst")
    )
    return found.where("src is not null and dst is not null and src <> dst")


def alias_verdicts(edges: DataFrame, rules: list[UrlRule] | DataFrame) -> DataFrame:
    """(node, alias_verdict, component) of every url on an edge."""
    members = store.materialize(components(edges, "src", "dst"), "url-components")
    host, path = split_url(F.col("node"))
    split = members.select("component", host.alias("host"), path.alias("path"))
    per = judged(split, rules).select("component", F.col("ruled").alias("v")).groupBy("component").agg(
        F.coalesce(F.bool_or(F.col("v") == "allow"), F.lit(False)).alias("allowed"),
        F.coalesce(F.bool_or(F.col("v") == "block"), F.lit(False)).alias("blocked"),
    )
    verdict = F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block")
    verdicts = store.materialize(per.select("component", verdict.alias("alias_verdict")), "url-verdicts")
    return store.materialize(members.join(verdicts, "component"), "url-aliases")


def filter_urls(pages: DataFrame, rules: list[UrlRule] | DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict. ``rules``: a list, or a table (pattern, verdict). ``redirects``: more (src, dst) urls, such as
    those of HTTP answers."""
    edges = page_edges(pages)
    if redirects is not None:
        more = redirects.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst"))
        edges = edges.union(more.where("src is not null and dst is not null and src <> dst"))
    edges = store.materialize(edges.distinct(), "url-edges")
    host, path = split_url(F.col("url"))
    split = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    ruled = judged(split, rules)
    if edges.isEmpty():
        final = ruled.withColumn("verdict", F.coalesce("ruled", F.lit("allow")))
    else:
        aliases = alias_verdicts(edges, rules).select("node", "alias_verdict")
        final = (
            ruled.withColumn("node", node_of(F.col("url")))
            .join(aliases, "node", "left")
            .withColumn("verdict", F.coalesce("ruled", "alias_verdict", F.lit("allow")))
        )
    return final.select("page_id", "host", "path", "rule", "verdict")
