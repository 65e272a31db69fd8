"""URL filters with redirect equivalence, with DataFrame operations only.

Rules of host and path decide pages. Redirects and canonical links found in the pages are edges
between URLs; a page without a rule of its own takes the decision of its connected component:
allow if any of its URLs is explicitly allowed, else block if any is blocked, else allow.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmesh.operators.components import connected_components
from starmesh.plans.skew import by_degree

from .common import stored


@dataclass(frozen=True)
class Rule:
    """verdict for a host with all its subdomains, and paths that start with path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_QUERY = r"(?s)^.*?://[^?#]*(\?[^#]*)"
#: What holds no tags: comments, and elements whose content is text.
_TEXT = r"""(?is)<!--(?:-?>|.*?(?:--!?>|\z))|<(script|style|textarea|title|xmp|iframe|noembed|noframes)(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|\z)"""
#: An attribute's value, quoted or not, and a tag: quotes count only where a value begins.
_QUOTED = r"""(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)"""
_TAG = r"""(?is)<(?:link|meta|base)(?=[\s/])(?:[^>=]++|=\s*+""" + _QUOTED + r"""?+)*+>"""
_ATTRIBUTE = r"""(?is)[^\s"'<>/=]++(?:\s*+=\s*+""" + _QUOTED + r""")?+"""
_VALUE = r"""(?s)^[^=]*=\s*(?:"(.*)"|'(.*)'|(.*))$"""
_CONTENT = r"""(?is)(?<![\w-])url\s*=\s*["']?\s*([^"'\s]*)"""
#: Named references, and the characters that numbers of C1 controls stand for.
_NAMED = "\x02".join(f"{k}\x01{v}" for k, v in html5.items())
_C1 = "\x02".join(f"{i}\x01{bytes([i]).decode('cp1252')}" for i in range(128, 160) if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))


def lower_ascii(x: Column) -> Column:
    return F.translate(x, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def key_of(url: Column) -> Column:
    """What tells URLs apart: host, path and query; neither scheme nor fragment. Null without ://."""
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), path_of(url), F.coalesce(F.regexp_extract(url, _QUERY, 1), F.lit(""))))


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """struct(name, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<name: string, verdict: string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _known(literal: str, key: Column) -> Column:
    return F.try_element_at(F.str_to_map(F.lit(literal), F.lit("\x02"), F.lit("\x01")), key)


def _reference(x: Column) -> Column:
    """What stands after a &, with the reference that it begins with resolved as in an attribute."""
    name = F.regexp_extract(x, r"^[A-Za-z][A-Za-z0-9]*;?", 0)
    after = F.substr(x, F.length(name) + 1)
    # Without a semicolon, and before =, a name is part of a query.
    named = F.when(F.startswith(after, F.lit("=")) & ~F.endswith(name, F.lit(";")), F.lit(None)).otherwise(_known(_NAMED, name))
    number = F.regexp_extract(x, r"^#(?:[0-9]+|[xX][0-9A-Fa-f]+);?", 0)
    hexed = F.regexp_extract(number, r"^#[xX]0*([0-9A-Fa-f]*)", 1)
    digits = F.regexp_extract(number, r"^#0*([0-9]*)", 1)
    code = F.when(F.rlike(number, F.lit("^#[xX]")), F.when(F.length(hexed) < 7, F.conv(hexed, 16, 10))).when(F.length(digits) < 8, digits)
    code = F.when(code != "", code.cast("long"))
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    char = F.when(valid, F.coalesce(_known(_C1, code.cast("string")), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))).otherwise("\ufffd")
    literal = F.concat(F.lit("&"), x)
    return F.when(number != "", F.concat(char, F.substr(x, F.length(number) + 1))).when(name != "", F.coalesce(F.concat(named, after), literal)).otherwise(literal)


def decoded(x: Column) -> Column:
    """An attribute's value without character references."""
    parts = F.split(x, "&")
    return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), _reference), ""))


def _attribute(attributes: Column, name: str) -> Column:
    """The value of the first attribute of this name, references resolved; null where there is none."""
    own = F.get(F.filter(attributes, lambda a: lower_ascii(F.regexp_extract(a, r"^[^\s=]+", 0)) == name), F.lit(0))
    return decoded(F.concat(*[F.regexp_extract(own, _VALUE, i) for i in (1, 2, 3)]))


def tags_of(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page, url, pos, tag, href, rel, equiv, content): the link, meta and base tags of pages that have
    an alias or may have one, with their attributes. Tags in comments, scripts and the like are none."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    found = pages.where(F.lower(html).contains("canonical") | F.lower(html).contains("refresh"))
    found = found.select(F.monotonically_increasing_id().alias("page"), F.col(url_col).alias("url"), F.regexp_extract_all(F.regexp_replace(html, _TEXT, " "), F.lit(_TAG), F.lit(0)).alias("tags"))
    found = found.select("page", "url", F.posexplode_outer("tags").alias("pos", "text")).where("text is not null")
    # Each step is written: the optimizer would put one's expressions in all places of the next.
    found = stored(found.select("page", "url", "pos", lower_ascii(F.substring("text", 2, 4)).alias("tag"), F.regexp_extract_all("text", F.lit(_ATTRIBUTE), F.lit(0)).alias("a")), "url-tags")
    return stored(found.select("page", "url", "pos", "tag", *[_attribute(F.col("a"), name).alias(c) for c, name in (("href", "href"), ("rel", "rel"), ("equiv", "http-equiv"), ("content", "content"))]), "url-attributes")


def _clean(link: Column) -> Column:
    inner = F.regexp_replace(F.regexp_replace(link, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
    return F.replace(inner, F.lit(" "), F.lit("%20"))


def _without_dots(path: Column) -> Column:
    """A path that begins with / without its segments . and .. (RFC 3986, 5.2.4)."""
    parts = F.split(path, "/")
    parts = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    up = lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", up(a)).when(s == ".", a).otherwise(F.concat(a, F.array(s))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(F.rlike(path, F.lit(r"/\.\.?$")) & (F.size(kept) > 0), "/").otherwise(""))


def absolute(link: Column, url: Column) -> Column:
    """A link's URL as seen from url: absolute, //host, /path, ?query or a path from url's directory. Null
    for links of no host, such as mailto:, and for those to a place of the page itself."""
    scheme, ref = F.substring_index(url, "://", 1), F.regexp_replace(link, r"(?s)#.*$", "")
    path, query = F.regexp_extract(ref, r"(?s)^[^?]*", 0), F.regexp_extract(ref, r"(?s)\?.*$", 0)
    root = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.concat(F.lit("/"), F.regexp_extract(path_of(url), r"(?s)^/(.*/)?", 1))
    out = F.when(F.rlike(link, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*://")), link).when(F.rlike(link, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*:")) | (ref == ""), F.lit(None))
    out = out.when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link)).when(path == "", F.concat(root, path_of(url), query))
    return out.when(F.startswith(path, F.lit("/")), F.concat(root, _without_dots(path), query)).otherwise(F.concat(root, _without_dots(F.concat(folder, path)), query))


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(from_key, to_key): canonical links and refresh redirects of the pages, of all their tags, other
    than to themselves. rel is a list of words; a page's first base with an address is what its links
    are seen from."""
    tags = tags_of(pages, url_col, html_col)
    canonical = (F.col("tag") == "link") & F.array_contains(F.split(lower_ascii(F.col("rel")), r"[ \t\n\f\r]+"), "canonical")
    refresh = (F.col("tag") == "meta") & (lower_ascii(F.trim("equiv")) == "refresh")
    link = F.when(canonical, _clean(F.col("href"))).when(refresh, F.regexp_extract("content", _CONTENT, 1))
    bases = tags.where("tag = 'base' and href is not null").groupBy("page").agg(F.min_by("href", "pos").alias("base"))
    found = stored(tags.select("page", "url", link.alias("link")).where("link != ''").join(bases, "page", "left"), "url-links")
    found = stored(found.select("url", "link", F.when(F.col("base").isNull(), F.col("url")).otherwise(F.coalesce(absolute(_clean(F.col("base")), F.col("url")), "url")).alias("seen_from")), "url-bases")
    found = stored(found.select("url", absolute(F.col("link"), F.col("seen_from")).alias("to")), "url-targets")
    return found.select(key_of(F.col("url")).alias("from_key"), key_of(F.col("to")).alias("to_key")).where("from_key is not null and to_key is not null and from_key != to_key").distinct()


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", edges: DataFrame | None = None) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict.

    A URL that is null or without :// has an empty host and path, fits no rule and has no
    aliases: it is allowed. Repeated rows get equal verdicts; an empty table gives an empty
    result; other columns are ignored. edges can add redirects known from elsewhere, as
    (from_key, to_key). What URLs need to know of a hub of many aliases is broadcast to them, so its
    aliases are never gathered in one task.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), key_of(url).alias("key"))
    rows = rows.withColumn("own", rule_for(F.col("host"), F.col("path"), rules))
    found = alias_edges(pages, url_col, html_col)
    if edges is not None:
        found = found.unionByName(edges.select("from_key", "to_key"))
    found = stored(found, "url-edges")
    # Only URLs that have an edge are vertices; they are numbered once.
    keys = stored(found.select(F.col("from_key").alias("key")).union(found.select("to_key")).distinct().withColumn("id", F.monotonically_increasing_id()), "url-keys")
    n = found.count()
    sized = lambda c: keys.toDF(c, f"{c}_id").join(found.groupBy(c).agg(F.count(F.lit(1)).alias("__size")), c)
    numbered = by_degree(by_degree(found, sized("from_key"), "from_key", "__size", n).drop("__size"), sized("to_key"), "to_key", "__size", n).select(F.col("from_key_id").alias("a"), F.col("to_key_id").alias("b"))
    component = keys.join(connected_components(numbered), "id") if not keys.isEmpty() else keys.withColumn("component", F.lit(0).cast("long"))
    # A key begins with its host and path, which is all that rules ask for.
    key_url = F.concat(F.lit("x://"), F.col("key"))
    component = stored(component, "url-components")
    judged = component.withColumn("own", rule_for(host_of(key_url), path_of(key_url), rules))
    whole = judged.groupBy("component").agg(F.max(F.coalesce(F.col("own.verdict") == "allow", F.lit(False))).alias("allowed"), F.max(F.coalesce(F.col("own.verdict") == "block", F.lit(False))).alias("blocked"), F.count(F.lit(1)).alias("__size"))
    decided = by_degree(component, whole, "component", "__size", 2 * n).select("key", F.when(F.col("blocked") & ~F.col("allowed"), "block").otherwise("allow").alias("of_aliases"))
    out = rows.join(decided, "key", "left")
    return out.select("page_id", "host", "path", F.col("own.name").alias("rule"), F.coalesce("own.verdict", "of_aliases", F.lit("allow")).alias("verdict"))
