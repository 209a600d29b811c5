"""URL filtering with redirect equivalence, in DataFrame operations only.

Each URL is judged by the longest rule that fits its host or a parent domain
and its path.  Rules are a table: the host's suffixes are joined with the rules'
hosts, which tell the lengths of path starts to look up, and those are joined
with the rules.  URLs that no rule fits take the decision of their aliases: URLs
are nodes, canonical links, immediate refreshes and recorded redirects are
edges, and within a connected component an explicit allow goes before a block.
All of this is done once per distinct URL; pages meet their URL's verdict last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .runtime import durable, spread_join

#: Rules of more bytes than this are not broadcast.
BROADCAST_BYTES = 16 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def with_node(rows: DataFrame, url: str, name: str) -> DataFrame:
    """``rows`` with the key of a URL column as a node: scheme and host lower-cased, ``/`` for an empty path, no fragment; null without a host."""
    split = rows.withColumn("_rest", _after_scheme(F.col(url)))
    split = split.withColumn("_host", F.translate(F.regexp_extract("_rest", r"^[^/?#]*", 0), _UPPER, _LOWER)).withColumn("_tail", F.regexp_extract("_rest", r"^[^/?#]*([^#]*)", 1))
    scheme = F.translate(F.substring_index(F.col(url), "://", 1), _UPPER, _LOWER)
    tail = F.when(F.col("_tail").startswith("/"), F.col("_tail")).otherwise(F.concat(F.lit("/"), F.col("_tail")))
    return split.withColumn(name, F.when(F.col("_host") != "", F.concat(scheme, F.lit("://"), F.col("_host"), tail))).drop("_rest", "_host", "_tail")


def resolved(rows: DataFrame, base: str, target: str, name: str) -> DataFrame:
    """``rows`` with the absolute URL of the link ``target`` on the page ``base``; null for links within a page and other schemes."""
    split = rows.withColumn("_link", F.regexp_replace(F.trim(F.col(target)), "&amp;", "&")).withColumn("_rest", _after_scheme(F.col(base)))
    split = split.withColumn("_site", F.concat(F.substring_index(F.col(base), "://", 1), F.lit("://"), F.regexp_extract("_rest", r"^[^/?#]*", 0)))
    split = split.withColumn("_path", F.regexp_extract("_rest", r"^[^/?#]*(/[^?#]*)", 1)).withColumn("_folder", F.regexp_extract("_path", r"^.*/", 0))
    link, root = F.col("_link"), lambda c: F.when(c == "", "/").otherwise(c)
    full = (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.substring_index(F.col(base), "://", 1), F.lit(":"), link))
        .when(link.startswith("/"), F.concat("_site", link))
        .when(link.rlike(r"^(#|$|[A-Za-z][A-Za-z0-9+.-]*:)"), F.lit(None))
        .when(link.startswith("?"), F.concat(F.col("_site"), root(F.col("_path")), link))
        .otherwise(F.concat(F.col("_site"), root(F.col("_folder")), link))
    )
    return split.withColumn(name, full).drop("_link", "_rest", "_site", "_path", "_folder")


def _proper(edges: DataFrame) -> DataFrame:
    """Edges with two different ends. A plain filter would be pushed below the columns it reads and compute them again, term by term."""
    return edges.select(F.inline(F.filter(F.array(F.struct("src", "dst")), lambda e: e["src"] != e["dst"])))


def _attribute(tag: str, name: str) -> Column:
    raw = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", 1)
    return F.regexp_replace(raw, "^[\"']|[\"']$", "")


def declared_aliases(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges ``(src, dst)`` from pages to the targets of their canonical links and zero-delay refreshes."""
    tags = F.regexp_extract_all(F.col(html_col), F.lit(r"(?i)<(?:link|meta)\s[^>]*>"), F.lit(0))
    telling = F.filter(tags, lambda x: F.lower(x).rlike("canonical|refresh"))
    found = pages.where(F.col(url_col).isNotNull() & F.col(html_col).isNotNull()).select(F.col(url_col).alias("url"), F.explode(telling).alias("tag"))
    named = found.select("url", F.lower(_attribute("tag", "rel")).alias("rel"), _attribute("tag", "href").alias("href"), F.lower(_attribute("tag", "http-equiv")).alias("equiv"), _attribute("tag", "content").alias("content"))
    refresh = F.regexp_extract("content", r"(?i)^\s*0*(?:\.0*)?\s*[;,]\s*url\s*=\s*['\"]?([^'\"]+)", 1)
    target = F.when(F.col("rel").rlike(r"(^|\s)canonical(\s|$)"), F.col("href")).when(F.col("equiv") == "refresh", refresh)
    linked = named.select("url", target.alias("target")).where("target <> ''")
    edges = with_node(with_node(resolved(linked, "url", "target", "to"), "url", "src"), "to", "dst")
    return _proper(edges)


def rule_table(spark: SparkSession, rules: DataFrame | Sequence[tuple[str, str, str]]) -> DataFrame:
    """``(at, start, size, allow, rule)`` of rules ``(verdict, host, path start)``, each host and start once; an allow wins over an equal block."""
    if not isinstance(rules, DataFrame):
        written = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(s).alias("start")) for v, h, s in rules]
        rules = spark.range(1).select(F.inline(F.array(*written)) if written else F.inline(F.array().cast("array<struct<verdict:string,host:string,start:string>>")))
    verdict, host, start = (F.col(f"`{c}`") for c in rules.columns[:3])
    named = rules.select(F.translate(host, _UPPER, _LOWER).alias("at"), start.alias("start"), (verdict == "allow").alias("allow")).where("at IS NOT NULL AND start IS NOT NULL AND allow IS NOT NULL")
    once = named.groupBy("at", "start").agg(F.max("allow").alias("allow"))
    return once.select("at", "start", (F.length("at") + F.length("start")).alias("size"), "allow", F.concat("at", "start").alias("rule"))


def best_rules(urls: DataFrame, rules: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(url, best)`` of the distinct ``(url, host, path)`` that a rule of ``rule_table`` fits: the longest, ``(size, allow, rule)``.

    Rules up to ``broadcast_bytes`` are broadcast.  Beyond that hosts with very
    many URLs are joined apart from the others.
    """
    rules = durable(rules)
    known = rules.agg(F.max(F.size(F.split("at", r"\."))).alias("labels"), F.sum(F.octet_length("rule") * 2 + 64).alias("bytes")).first()
    labels, small = known["labels"] or 0, (known["bytes"] or 0) <= broadcast_bytes
    hosts = rules.groupBy("at").agg(F.collect_set(F.length("start")).alias("lengths"))  # as many as a host's rules have different lengths
    parts = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.greatest(F.size(parts) - labels + 1, F.lit(1)), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    suffixes = urls.select("url", "path", F.explode(ends if labels else F.array().cast("array<string>")).alias("at"))

    def met(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
        if small:
            return rows.join(F.broadcast(table), key)
        return spread_join(rows, durable(table.join(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), key)), key, "_n")

    tried = met(suffixes, hosts, "at").select("url", "at", "path", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    begun = tried.select("url", F.struct("at", F.expr("substring(path, 1, n)").alias("start")).alias("key"))
    table = rules.select(F.struct("at", "start").alias("key"), F.struct("size", "allow", "rule").alias("best"))
    return met(begun, table, "key").groupBy("url").agg(F.max("best").alias("best"))


def judge_urls(pages: DataFrame, rules: DataFrame | Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", redirects: DataFrame | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(id, url, host, path, rule, verdict)`` of every row; ``rules`` are (``allow`` or ``block``, host, path start), a list or a table of any size.

    ``redirects`` may add ``(src, dst)`` URLs to the edges found in the pages.
    A page with a fitting rule has its verdict; of equally long rules an allow
    wins, and rules with a null are ignored.  Any other page is allowed if an
    explicit allow is among its aliases or no block is, and blocked otherwise.
    Null URLs and those without ``://`` have an empty host and path, no aliases
    and are allowed, unless a rule for the empty host fits.  Repeated rows are
    judged alike; very long URLs are judged whole; other columns of ``pages`` are
    not read, whatever their names; an empty table gives none.
    """
    table = rule_table(pages.sparkSession, rules)
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"))
    edges = declared_aliases(pages, url_col, html_col)
    if redirects is not None:
        known = with_node(with_node(redirects.select(F.col("src").alias("s"), F.col("dst").alias("d")), "s", "src"), "d", "dst")
        edges = edges.union(_proper(known))
    parts = durable(connected_components(edges, "src", "dst", finish_edges=0))
    # nodes are URLs in a normal form, so they are judged together with the pages' URLs
    distinct = rows.groupBy(F.coalesce("url", F.lit("")).alias("url")).agg(F.count(F.lit(1)).alias("n"))
    both = distinct.unionByName(parts.select(F.col("node").alias("url"), F.lit(0).cast("long").alias("n"))).groupBy("url").agg(F.sum("n").alias("n"))
    urls = durable(with_node(both, "url", "node").select("url", "n", "node", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")))
    ruled = durable(urls.join(best_rules(urls, table, broadcast_bytes), "url", "left"))
    verdicts = parts.join(ruled.select(F.col("url").alias("node"), F.col("best.allow").alias("allow")), "node").groupBy("root").agg(F.max("allow").alias("allowed"))
    aliases = parts.join(verdicts, "root").where("NOT allowed").select("node")
    uses = ruled.where("node IS NOT NULL AND best IS NULL AND n > 0").groupBy("node").agg(F.count(F.lit(1)).alias("uses"))
    blocked = durable(aliases.join(uses, "node").select("node", F.lit(True).alias("blocked"), "uses"))
    apart = ruled.withColumn("node", F.when(F.col("best").isNull(), F.col("node")))
    found = spread_join(apart.where("node IS NOT NULL"), blocked, "node", "uses", "left").unionByName(apart.where("node IS NULL").withColumn("blocked", F.lit(False)))
    verdict = F.when(F.col("best").isNotNull(), F.when(F.col("best.allow"), "allow").otherwise("block")).when(F.col("blocked"), "block").otherwise("allow")
    judged = durable(found.where("n > 0").select(F.col("url").alias("_url"), "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "n"))
    return spread_join(rows.withColumn("_url", F.coalesce("url", F.lit(""))), judged, "_url", "n").select("id", "url", "host", "path", "rule", "verdict")
