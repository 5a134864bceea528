"""URL rules, and block decisions that pass on to aliases, with DataFrame functions only.

A rule names a host, with all its subdomains, and the beginning of a path; the longest that fits decides.  Pages that
redirect to each other or name each other as canonical are aliases: connected components over these edges, at any
distance.  A page without a rule is blocked if any alias is blocked by a rule.  An explicit allow of a page's own url
takes precedence over all its aliases.  Urls that differ in scheme or fragment only are one.

Edge cases: a url that is null or has no `://` has neither host nor path, fits no rule and has no alias; it is allowed.
Links to targets that are not pages count, and can be blocked by rules.  Every canonical and refresh tag of a page is
read; character references in targets are decoded, and relative targets resolved against the page's url or its
`<base>`.  Repeated rows get the same verdict; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.components import components
from vigil.llm.shared import checked_broadcast, stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
URL = r"^(?s)(.*?)://([^/?#]*)([^?#]*)(\?[^#]*)?"
# what the comparison SQL reads: the first tag of each kind, without character references
CANONICAL_TAG = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
CANONICAL_HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH_TAG = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"
# a quoted value may hold `>`; a quote is one after `=` only
TAG = r"""(?is)<%s(?=[\s/])(?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+>"""
ATTRIBUTE = r"""(?is)[^\s"'<>/=]+\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)"""
REFRESH = r"""(?is)^\s*(?:[0-9.]+\s*[;,\s]\s*(?:url\s*=\s*)?|url\s*=\s*)(?:"([^"]*)|'([^']*)|([^"'].*))"""
REFERENCE = r"^(?:#0*([0-9]+)|#[xX]0*([0-9a-fA-F]+)|([A-Za-z][A-Za-z0-9]*));?"
DOTS = r"/\.\.?(/|$)"


def url_part(url: str | Column, group: int) -> Column:
    """Scheme (1), host (2), path (3) or query (4) of a url; empty where there is none."""
    part = F.coalesce(F.regexp_extract(url, URL, group), F.lit(""))
    return F.translate(part, UPPER, UPPER.lower()) if group == 2 else part


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def without_dots(path: Column) -> Column:
    """A path without its segments `.` and `..`."""
    parts = F.split(path, "/")

    def step(kept: Column, part: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(part == ".", kept).when(part == "..", up).otherwise(F.array_append(kept, part))

    last = F.when(path.rlike(r"/\.\.?$"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array().cast("array<string>"), step)
    return F.when(path.rlike(DOTS), F.concat(F.lit("/"), F.array_join(F.concat(kept, last), "/"))).otherwise(path)


def node(url: str | Column) -> Column:
    """What stands for a url among aliases: without scheme, fragment and dot segments; null where there is no host."""
    whole = F.concat(url_part(url, 2), without_dots(url_part(url, 3)), url_part(url, 4))
    return F.when(whole != "", whole)


def unescaped(text: Column) -> Column:
    """The value of an attribute with its character references decoded, once."""
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    parts = F.split(text, "&")

    def one(part: Column) -> Column:
        whole, word = F.regexp_extract(part, REFERENCE, 0), F.regexp_extract(part, REFERENCE, 3)
        digits, hexed = F.regexp_extract(part, REFERENCE, 1), F.regexp_extract(part, REFERENCE, 2)
        code = F.when(F.length(digits) + F.length(hexed) > 7, F.lit(0)).when(digits != "", F.conv(digits, 10, 10).cast("long")).when(
            hexed != "", F.conv(hexed, 16, 10).cast("long"))
        exists = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        coded = F.when(exists, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).when(code.isNotNull(), F.lit("\ufffd"))
        rest = F.substr(part, F.length(whole) + 1)
        # an old name without its semicolon is a parameter of the url if `=` follows
        named = F.when((word != "") & (whole.endswith(";") | ~rest.startswith("=")), F.element_at(names, whole))
        return F.coalesce(F.concat(F.coalesce(coded, named), rest), F.concat(F.lit("&"), part))

    rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)), one)
    return F.when(text.contains("&"), F.concat(parts[0], F.array_join(rest, ""))).otherwise(text)


def tags(name: str) -> Column:
    """The attributes of all tags of a name in `html`, as they are written, by tag."""
    return F.transform(F.regexp_extract_all("html", F.lit(TAG % name), F.lit(0)),
                       lambda tag: F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0)))


def attribute(tag: Column, name: str) -> Column:
    """The value of the first attribute of a name, as it is written; null without one."""
    own = F.get(F.filter(tag, lambda x: x.rlike(rf"(?i)^{name}\s*=")), F.lit(0))
    return F.regexp_replace(own, r"""(?s)^[^=]*=\s*["']?|["']$""", "")


def resolved(base: Column, to: Column) -> Column:
    """A target as a whole url: as it is if it has a scheme, otherwise found from the url of its page."""
    scheme, path, query = url_part(base, 1), url_part(base, 3), url_part(base, 4)
    site = F.concat(scheme, F.lit("://"), url_part(base, 2))
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, "[^/]*$", ""))
    return (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), to)
        .when(to.startswith("//"), F.concat(scheme, F.lit(":"), to)).when(to.startswith("/"), F.concat(site, to))
        .when(to.startswith("?"), F.concat(site, path, to)).when((to == "") | to.startswith("#"), F.concat(site, path, query))
        .otherwise(F.concat(site, folder, to)))


def cleaned(text: Column) -> Column:
    """A target as a browser reads it: without line breaks, tabs and outer blanks."""
    return F.replace(F.trim(F.regexp_replace(text, r"[\t\n\r]", "")), F.lit(" "), F.lit("%20"))


def page_links(pages: DataFrame) -> DataFrame:
    """(a, b): nodes of pages and of what they redirect to or name as canonical; stored on the way."""
    none = F.array().cast("array<string>")

    def values(word: str, tag: str, key: str, inner: str) -> Column:
        # most pages lack the word, and are not searched any further
        fits = F.filter(tags(tag), lambda x: attribute(x, key).rlike(rf"(?i)(^|\s){word}(\s|$)"))
        return F.when(F.col("html").rlike(f"(?i){word}"), F.transform(fits, lambda x: attribute(x, inner))).otherwise(none)

    raw = pages.select(
        "url", "html", values("canonical", "link", "rel", "href").alias("canonical"),
        values("refresh", "meta", "http-equiv", "content").alias("refresh"),
    ).where("size(canonical) + size(refresh) > 0")
    hrefs = F.filter(F.transform(tags("base"), lambda x: attribute(x, "href")), lambda x: x.isNotNull())
    both = F.concat(
        F.transform("canonical", lambda x: F.struct(x.alias("value"), F.lit(False).alias("timed"))),
        F.transform("refresh", lambda x: F.struct(x.alias("value"), F.lit(True).alias("timed"))))
    found = raw.select("url", F.get(hrefs, F.lit(0)).alias("base"), F.explode(both).alias("at")).where("at.value != ''")
    # stored, so that the table of names is in one plan once
    decoded = stored(found.select(
        "url", F.transform(F.array("base", "at.value"), unescaped).alias("decoded"), F.col("at.timed").alias("timed")), "targets")
    value = F.col("decoded")[1]
    after = F.concat(*(F.regexp_extract(value, REFRESH, i) for i in (1, 2, 3)))
    links = decoded.select(
        "url", cleaned(F.col("decoded")[0]).alias("base"), cleaned(F.when(F.col("timed"), after).otherwise(value)).alias("to")).where("to != ''")
    base = F.coalesce(bound(F.col("base"), lambda b: resolved(F.col("url"), b)), "url")
    ends = bound(F.struct(base.alias("base"), F.col("to").alias("to")), lambda x: bound(resolved(x["base"], x["to"]), node))
    return links.select(node("url").alias("a"), ends.alias("b")).where("a != b")


def decided(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, decision) of the distinct hosts and paths that a rule fits.

    rules: (rule_host, rule_path, decision).  Each host is joined by its own suffixes, so that rules are never scanned.
    """
    places = nodes.select("host", "path").where("host != ''").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    near = places.select("host", "path", F.explode(suffixes).alias("suffix"))
    fits = near.join(checked_broadcast(rules), F.col("suffix") == F.col("rule_host")).where(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    longest = F.struct(F.length(rule), F.length("rule_host"), rule)
    return fits.groupBy("host", "path").agg(F.max_by(F.struct(rule.alias("rule"), "decision"), longest).alias("best")).select(
        "host", "path", "best.*")


def judged(pages: DataFrame, rules: DataFrame, links: DataFrame) -> DataFrame:
    """pages with `host`, `path`, `rule` and `verdict` (allow or block).

    links: (a, b) of nodes; rules must be stored or local.
    """
    placed = pages.withColumns({"host": url_part("url", 2), "path": url_part("url", 3), "node": node("url")})
    links = stored(links, "links")
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    ends = ends.select("node", F.regexp_extract("node", r"^[^/?]*", 0).alias("host"), F.regexp_extract("node", r"^[^/?]*([^?]*)", 1).alias("path"))
    ends = stored(ends, "link-ends")
    choices = stored(decided(placed.select("host", "path").union(ends.select("host", "path")), rules), "choices")
    named = choices.select(F.col("host").alias("of_host"), F.col("path").alias("of_path"), "rule", "decision")
    here = (F.col("host") == F.col("of_host")) & (F.col("path") == F.col("of_path"))
    # both sides grow with the pages: a shuffle join at any size
    rows = placed.hint("merge").join(named, here, "left").drop("of_host", "of_path")
    if not links.isEmpty():
        groups = stored(components(links), "aliases")
        blocked = ends.join(named.where("decision = 'block'"), here).select("node").join(groups, "node")
        bad = stored(groups.join(blocked.select("component").distinct(), "component", "left_semi").select(
            F.col("node").alias("bad"), F.lit("block").alias("inherited")), "blocked-aliases")
        rows = rows.join(checked_broadcast(bad), F.col("node") == F.col("bad"), "left").drop("bad")
    else:
        rows = rows.withColumn("inherited", F.lit(None).cast("string"))
    verdict = F.coalesce("decision", "inherited", F.lit("allow"))
    return rows.withColumn("verdict", verdict).drop("decision", "inherited", "node")
