"""URL rules whose block decisions reach redirect and canonical-link aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.llm.components import connected_components
from rookery.llm.storage import cut

#: (verdict, host, path): the rules of the contract.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: from there up to ? # or the end.
    Both are empty for a null url and one without ://."""
    pattern = r"(?s)^.*?://([^/?#]*+)([^?#]*+)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule fits its host, all hosts below it, and paths it begins."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tried first: it ends up outermost
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def without_dots(path: Column) -> Column:
    """path without . and .. segments, which go up from what stands before them."""

    def step(kept: Column, part: Column) -> Column:
        up = F.when(F.size(kept) > 1, F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)
        return F.when(part == "..", up).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))

    parts = F.split(path, "/")
    kept = F.array_join(F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.lit("")), step), "/")
    folder = path.rlike(r"/\.\.?$")  # a path that ends in a dot segment names a folder
    return F.when(path.contains("/."), F.concat(kept, F.when(folder, "/").otherwise(""))).otherwise(path)


def alias_key(url: Column) -> Column:
    """What spellings of one address share: no scheme, no fragment, no dot segments, host in lower case; null if there is no host."""
    host, path = host_and_path(url)
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*+(\?[^#]*+)", 1)
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(without_dots(path)), query))


#: Character references that stand in addresses, the ampersand last.
REFERENCES = (("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&#x27;", "'"), ("&#47;", "/"), ("&#x2f;", "/"), ("&#x2F;", "/"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"))


def decoded(value: Column) -> Column:
    """An attribute's value with its character references resolved."""
    for name, sign in REFERENCES:
        value = F.replace(value, F.lit(name), F.lit(sign))
    return value


def link_targets(html: Column) -> Column:
    """Targets of <link rel=canonical href=...> and <meta http-equiv=refresh content="0;url=..."> in a page."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*+>"), F.lit(0))
    value = r"""\s*=\s*(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))"""

    def attribute(tag: Column, name: str) -> Column:
        return decoded(F.concat(*[F.regexp_extract(tag, rf"(?is)\s{name}{value}", i) for i in (1, 2, 3)]))

    def target(tag: Column) -> Column:
        canonical = F.lower(F.trim(attribute(tag, "rel"))) == "canonical"
        refresh = F.lower(F.trim(attribute(tag, "http-equiv"))) == "refresh"
        moved = F.regexp_extract(attribute(tag, "content"), r"""(?is)^\s*[0-9.]*\s*[;,]\s*url\s*=\s*['"]?([^'"]*)""", 1)
        return F.when(canonical, F.trim(attribute(tag, "href"))).when(refresh, F.trim(moved))

    found = F.transform(F.coalesce(tags, F.array().cast("array<string>")), target)
    return F.filter(found, lambda t: t.isNotNull() & (t != ""))


def absolute(link: Column, url: Column) -> Column:
    """The link as seen from url, by the rules for relative references: a scheme of its own, //host/path, /path, ?query, #fragment,
    or a path below url's folder. Dot segments stay; alias_key takes them out."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    root = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*+)", 1)
    page = F.regexp_extract(url, r"(?s)^(.*?://[^?#]*+)", 1)
    whole = F.regexp_extract(url, r"(?s)^([^#]*+)", 1)
    folder = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*+[^?#]*/)", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(page, link))
        .when(link.startswith("#"), F.concat(whole, link))
        .otherwise(F.concat(F.when(folder == "", F.concat(root, F.lit("/"))).otherwise(folder), link))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """Edges (src, dst) between alias keys: canonical and refresh links of pages that have any."""
    has = F.col("html").rlike(r"(?i)\bcanonical\b|http-equiv\s*=\s*[\"']?refresh")
    links = pages.where(has).select("url", F.explode(link_targets(F.col("html"))).alias("link"))
    return links.select(alias_key(F.col("url")).alias("src"), alias_key(absolute(F.col("link"), F.col("url"))).alias("dst"))


def url_verdicts(pages: DataFrame, rules: tuple = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page.

    A page's own rule decides it, so an explicit allow holds whatever its aliases are. A page without a rule is
    blocked if any address in its equivalence class is blocked by a rule, be it a page of the table or a mere link
    target, and allowed otherwise. The classes are the connected components of redirect and canonical links:
    those found in html, and `redirects` (from_url, to_url) if given. Addresses that differ only in scheme,
    fragment or the case of the host are one.

    Null urls and urls without :// have empty host and path, no rule and no alias, and are allowed. Null html has no
    links. Repeated pages each get their row. Columns beyond page_id, url and html are ignored.
    """
    pages = pages.select("page_id", "url", "html")
    edges = page_links(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(alias_key(F.col("from_url")), alias_key(F.col("to_url"))))
    edges = cut(edges.distinct(), "links")
    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = judged.select("page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("own"))
    if edges.isEmpty():
        return judged.select("page_id", "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"))
    classes = connected_components(edges, "src", "dst")
    h, p = host_and_path(F.concat(F.lit("x://"), F.col("node")))
    blocked = classes.where(rule_of(h, p, rules)[1] == "block").select("component").distinct()
    bad = cut(classes.join(blocked, "component", "left_semi").select(F.col("node").alias("__node")), "aliases")
    # only rows without a rule look up their class; their addresses are spread over the table
    open_rows, closed = judged.where("own IS NULL"), judged.where("own IS NOT NULL")
    open_rows = open_rows.join(bad, alias_key(F.col("url")) == F.col("__node"), "left")
    verdict = F.when(F.col("__node").isNotNull(), "block").otherwise("allow")
    return open_rows.select("page_id", "host", "path", "rule", verdict.alias("verdict")).union(closed.select("page_id", "host", "path", "rule", "own"))
