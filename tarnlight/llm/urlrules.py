"""URL rules, and their spread over redirect and canonical-link equivalence, in DataFrame operations only.

A url's host runs from the first :// to the next /, ? or #, with A-Z lower-cased; its path from there to ? or #.
A rule (verdict, host, path) fits its host and all subdomains where the url's path starts with the rule's; the
rule with the longest text wins, on a tie the one that sorts first, then block. Few rules become one expression;
more than `INLINE` are joined on the suffixes of distinct hosts, so both ways give the same.

Urls are equivalent when redirects, canonical links or refreshes connect them, or where asked for an equal value of
the pages (as their article: mirrors): the connected components of those edges, over urls without scheme and
fragment. Links in comments, scripts and the like are none; a page may have several. A url with a rule of its own
keeps that rule's verdict. One without is blocked if a member of its component is blocked by a rule and no member is
explicitly allowed; else allowed. A member is judged by its path as it is written: one without a path has no rule.

Defined cases: a null url, or one without ://, has empty host and path, no rule and no equivalence; null or
empty html has no link; repeated rows each give a row; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Salts, materialise

INLINE = 64
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """The url without scheme and fragment, or null where it has no host."""
    host = host_of(url)
    rest = F.regexp_extract(after_scheme(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(host != "", F.concat(host, F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))))


def resolved(base: Column, link: Column) -> Column:
    """link as an absolute url, from the page's url."""
    scheme = F.regexp_extract(base, r"^([^:/?#]*):", 1)
    site = F.regexp_extract(base, r"^([^:/?#]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([^:/?#]*://[^?#]*/)", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(site, link))
        .when((link != "") & (folder != site) & ~link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.concat(folder, link))
    )


UNSEEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|template|noscript|title|xmp)\b.*?(?:</\1\s*>|\z)"


def links(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """src, dst: canonical links and refreshes of pages, as urls."""
    html = F.col(f"`{html_col}`").cast("string")
    some = pages.select(F.col(f"`{url_col}`").cast("string").alias("src"), html.alias("html")).where(F.col("html").rlike("(?i)canonical|refresh"))
    tags = F.regexp_extract_all(F.regexp_replace("html", UNSEEN, " "), F.lit(r"(?is)<(?:link|meta)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"), F.lit(0))
    tag = some.select("src", F.explode(tags).alias("tag"))
    target = (
        F.when(F.col("tag").rlike(r"(?is)^<link\b.*?\srel\s*=\s*(?:[\"'][^\"'>]*\bcanonical\b|canonical\b)"), F.regexp_extract("tag", r"(?is)\shref\s*=\s*[\"']?\s*([^\"'\s>]*)", 1))
        .when(F.col("tag").rlike(r"(?is)^<meta\b.*?\shttp-equiv\s*=\s*[\"']?\s*refresh\b"), F.regexp_extract("tag", r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]*)", 1))
    )
    found = tag.select("src", F.replace(target, F.lit("&amp;"), F.lit("&")).alias("link")).where("link <> ''")
    return found.select("src", resolved(F.col("src"), F.col("link")).alias("dst"))


def article_of(html: Column) -> Column:
    """What stands in the first article element, or null."""
    found = F.regexp_extract(html.cast("string"), r"(?is)<article\b[^>]*>(.*?)</article\s*>", 1)
    return F.when(found != "", found)


def ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (with host and path) and rule, ruling: the text and verdict of the rule that wins, or null."""
    head = rules.select("verdict", "host", "path").dropna().distinct().limit(INLINE + 1).collect()  # bounded: as many as are put into one expression
    if len(head) <= INLINE:
        best = sorted((-len(h + p), h + p, v != "block", v, h, p) for v, h, p in head)
        rule, ruling = F.lit(None).cast("string"), F.lit(None).cast("string")
        for _, text, _, v, h, p in reversed(best):
            fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p))
            rule, ruling = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(ruling)
        return urls.withColumns({"rule": rule, "ruling": ruling})
    given = rules.select(F.col("host").alias("__h"), F.col("path").alias("__p"), F.col("verdict").alias("__v")).dropna().distinct()
    labels = F.split("host", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    pairs = urls.select("host", "path").distinct().withColumn("__h", F.explode(suffixes)).join(given, "__h").where(F.startswith("path", F.col("__p")))
    text = F.concat("__h", "__p")
    won = pairs.groupBy("host", "path").agg(F.min(F.struct((-F.length(text)).alias("n"), text.alias("rule"), (F.col("__v") != "block").alias("o"), F.col("__v").alias("ruling"))).alias("w"))
    return urls.join(won.select("host", "path", "w.rule", "w.ruling"), ["host", "path"], "left")


def rule_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def judge_urls(pages: DataFrame, rules: DataFrame, *, redirects: DataFrame | None = None, same: Column | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """id, host, path, rule, verdict of each page. redirects: src, dst (urls). same: an expression over the pages;
    urls of pages with one value of it, not null, are aliases of each other."""
    url = F.col(f"`{url_col}`").cast("string")
    base = pages.select(F.col(f"`{id_col}`").alias("__id"), F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"), node_of(url).alias("node"))
    judged = ruled(base, rules)
    named = links(pages, url_col, html_col) if html_col else None
    if redirects is not None:
        known = redirects.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
        named = known if named is None else named.unionByName(known)
    forms, edges = [], []  # urls of members as they are written; edges between nodes
    if named is not None:
        named = materialise(named, "links")  # read for its edges and for its urls
        forms += [named.select(F.col("src").alias("url")), named.select(F.col("dst").alias("url"))]
        edges += [named.select(node_of(F.col("src")).alias("u"), node_of(F.col("dst")).alias("v"))]
    if same is not None:
        # the value is a node beside the urls, so that its pages are a star; a url's node holds a slash, this doesn't
        pairs = materialise(pages.select(url.alias("url"), node_of(url).alias("u"), F.concat(F.lit("same:"), F.sha2(same.cast("string"), 256)).alias("v")).where("u IS NOT NULL AND v IS NOT NULL"), "same")
        counts = materialise(pairs.groupBy("v").agg(F.count(F.lit(1)).alias("n"), (F.min("u") < F.max("u")).alias("often")), "counts")
        salts = Salts(counts, "v")
        pairs = salts.left(pairs, ["u"]).join(salts.right(counts.where("often").select("v")), ["v", "__salt"], "left_semi")
        forms, edges = [*forms, pairs.select("url")], [*edges, pairs.select("u", "v")]
    if edges:
        groups = connected_components(reduce(DataFrame.unionByName, edges))
        urls = reduce(DataFrame.unionByName, forms).select(node_of(F.col("url")).alias("node"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("node IS NOT NULL").distinct()
        parts = ruled(urls, rules).where("ruling IS NOT NULL").join(groups, "node")
        spread = parts.groupBy("component").agg((F.max(F.col("ruling") == "block") & ~F.max(F.col("ruling") == "allow")).alias("spread"))
        sizes = materialise(groups.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "sizes")
        salts = Salts(sizes, "component")
        blocked = salts.left(groups, ["node"]).join(salts.right(spread.where("spread")), ["component", "__salt"]).select("node", F.lit("block").alias("alias"))
        judged = judged.join(blocked, "node", "left")
    else:
        judged = judged.withColumn("alias", F.lit(None).cast("string"))
    return judged.select(F.col("__id").alias(id_col), "host", "path", "rule", F.coalesce("ruling", "alias", F.lit("allow")).alias("verdict"))


def judge_mirrored(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """judge_urls with mirrors: urls of pages whose article is the same to the byte are aliases."""
    return judge_urls(pages, rules, same=article_of(F.col("html")))


#: Aliases here are urls that are equal but for scheme and fragment, and mirrors; the tables have no canonical link.
ORACLE_SQL = r"""
WITH RECURSIVE u AS (SELECT page_id, regexp_extract(html, '(?is)<article\b[^>]*>(.*?)</article\s*>', 1) AS art, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS s FROM pages),
p AS (SELECT row_number() OVER () AS r, page_id, art, translate(regexp_extract(s, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(s, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(s, '^[^/?#]*([^#]*)', 1) AS rest FROM u),
k(v, h, q) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (SELECT r, max_by(h || q, length(h || q)) AS rule, max_by(v, length(h || q)) AS v FROM p JOIN k ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY r),
n AS (SELECT r, page_id, host, path, nullif(art, '') AS art, CASE WHEN host <> '' THEN host || CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END END AS node, rule, v FROM p LEFT JOIN m USING (r)),
e AS (SELECT DISTINCT a.node AS x, b.node AS y FROM n a JOIN n b ON a.art = b.art AND a.node <> b.node),
c AS (SELECT x, x AS y FROM e UNION SELECT c.x, e.y FROM c JOIN e ON c.y = e.x),
s AS (SELECT x AS node, bool_or(v = 'block') AND NOT bool_or(v = 'allow') AS spread FROM c JOIN n ON n.node = c.y WHERE v IS NOT NULL GROUP BY x)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN spread THEN 'block' END, 'allow') AS verdict FROM n LEFT JOIN s USING (node)
"""
