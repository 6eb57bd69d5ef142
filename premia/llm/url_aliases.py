"""Block and allow rules for URLs, carried to their aliases; DataFrame functions only.

A rule names a host with its subdomains and the start of a path; the longest that fits
decides.  URLs that no rule fits take the decision of their aliases: URLs joined by a
redirect or canonical link in the page, by a redirect target in the URL, or by the same normal
form; targets may be relative to the page's URL, and all that a page names count.  Aliases are connected components.  An allowed alias outweighs any blocked one.

Defined results: a null URL, or one without ``://``, has an empty host and path, no aliases
and the verdict allow; repeated URLs are judged alike; html may be null; an empty table gives
an empty result; columns with other names are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from premia.llm.components import components
from premia.llm.tables import written

#: (verdict, host, start of the path); fixed values of the query.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    return lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, domain, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        name, verdict = F.when(fits, domain + start).otherwise(name), F.when(fits, say).otherwise(verdict)
    return name, verdict


def normal_form(url: Column) -> Column:
    """Host without www. or m., path without closing slash, query without tracking keys."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(r"^(ref|utm_[a-z]+|fbclid|gclid|session|sid)=")))
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^(www|m)\.", ""), r":(80|443)$", "")
    return F.concat(host, F.regexp_replace(path_of(url), r"/+$", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


#: scheme, authority, path and query of a reference; each is null where it is absent, but the path.
_REFERENCE = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?"
_ENTITIES = (("&#38;", "&"), ("&#x26;", "&"), ("&#x2F;", "/"), ("&#47;", "/"), ("&quot;", '"'), ("&amp;", "&"))


def without_dots(path: Column) -> Column:
    """A path that starts with a slash, without its segments ``.`` and ``..``."""
    parts = F.slice(F.split(path, "/", -1), 2, F.greatest(F.size(F.split(path, "/", -1)), F.lit(1)))
    none = F.array().cast("array<string>")
    step = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    closed = F.when(path.rlike(r"(?s)/\.\.?$"), "/").otherwise("")
    left = F.array_join(F.aggregate(parts, none, step), "/")
    return F.concat(F.lit("/"), left, F.when(left == "", "").otherwise(closed))


def resolved(base: Column, reference: Column) -> Column:
    """The URL that a reference in a page at ``base`` names (RFC 3986), without its fragment.

    Null where the base has no host, or the reference is empty, only a fragment or of a scheme without ``//``.
    """
    part = lambda text, k: F.regexp_extract(text, _REFERENCE, k)
    ref = F.trim(reference)
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    origin = F.concat(scheme, F.lit("://"), F.regexp_extract(base, r"(?s)^.*?://([^/?#]*)", 1))
    path, query = part(ref, 3), part(ref, 4)
    folder = F.regexp_extract(path_of(base), r"(?s)^(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))
    return (
        F.when(host_of(base) == "", None)
        .when((ref == "") | ref.startswith("#"), None)
        .when(ref.rlike(r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"), F.concat(F.coalesce(F.nullif(part(ref, 1), F.lit("")), scheme), F.lit("://"), part(ref, 2), F.when(path == "", "").otherwise(without_dots(path)), query))
        .when(part(ref, 1) != "", None)
        .when(path == "", F.concat(origin, path_of(base), query))
        .otherwise(F.concat(origin, without_dots(whole), query))
    )


def targets(url: Column, html: Column) -> Column:
    """URLs that the page or its URL names as itself: canonical links, refreshes, redirect keys."""
    body = F.coalesce(html, F.lit(""))
    tags = F.regexp_extract_all(body, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    attribute = lambda tag, name: F.coalesce(
        *[F.nullif(F.regexp_extract(tag, rf"(?is)[\s\"']{name}\s*=\s*{value}", 1), F.lit("")) for value in ('"([^"]*)"', "'([^']*)'", r"([^\s\"'>]+)")], F.lit("")
    )

    def named_by(tag: Column) -> Column:
        canonical = tag.rlike(r"(?i)^<link\b") & attribute(tag, "rel").rlike(r"(?i)(^|\s)canonical(\s|$)")
        refresh = tag.rlike(r"(?i)^<meta\b") & (F.lower(F.trim(attribute(tag, "http-equiv"))) == "refresh")
        to = F.regexp_extract(attribute(tag, "content"), r"""(?is)\burl\s*=\s*["']?([^"']+)""", 1)
        return F.when(canonical, attribute(tag, "href")).when(refresh, to).otherwise("")

    plain = lambda x: reduce(lambda y, e: F.replace(y, F.lit(e[0]), F.lit(e[1])), _ENTITIES, x)
    keys = F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&](?:url|redirect|redirect_uri|to|target)=([^&#]+)"), F.lit(1))
    # A key's value that names neither a path nor a host, such as a number or a word, is no URL.
    keyed = F.filter(F.transform(keys, F.try_url_decode), lambda x: x.rlike(r"(?i)^([a-z][a-z0-9+.-]*:/)?/|^\.\.?/"))
    linked = F.transform(F.transform(tags, named_by), plain)
    found = F.transform(F.concat(linked, keyed), lambda x: resolved(url, x))
    return F.filter(F.array_distinct(found), lambda x: x.contains("://"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url", html: str = "html", id: str = "page_id") -> DataFrame:
    """(id, url, host, path, rule, verdict, alias_verdict) of each page."""
    u = F.col(url)
    slim = pages.select(F.col(id).alias("id"), u.alias("url"), targets(u, F.col(html)).alias("targets"))
    slim = written(slim.withColumn("form", F.when(host_of(F.col("url")) != "", normal_form(F.col("url")))), "pages")
    named = slim.where("form is not null").select("form", F.explode("targets").alias("t"))
    links = named.select(F.col("form").alias("a"), normal_form(F.col("t")).alias("b")).distinct()
    groups = components(links)
    # Rules are met by whole URLs; each alias group then has the strongest word said in it.
    own = slim.where("form is not null").select("form", longest_rule(host_of(F.col("url")), path_of(F.col("url")), rules)[1].alias("say"))
    target_says = named.select(normal_form(F.col("t")).alias("form"), longest_rule(host_of(F.col("t")), path_of(F.col("t")), rules)[1].alias("say"))
    says = own.unionAll(target_says).where("say is not null").groupBy("form").agg(F.min("say").alias("say"))
    root = F.coalesce("component", "form").alias("root")
    decided = says.join(groups, says["form"] == groups["node"], "left").select(root, "say")
    decided = decided.groupBy("root").agg(F.min("say").alias("alias_verdict"))  # allow sorts before block
    # Back to the forms, and only those whose pages have no rule of their own need it.
    members = groups.select(F.col("node").alias("form"), F.col("component").alias("root"))
    linked = members.join(decided, "root").select("form", "alias_verdict")
    alone = decided.join(members.select("form").distinct(), decided["root"] == F.col("form"), "left_anti").select(F.col("root").alias("form"), "alias_verdict")
    table = written(linked.unionAll(alone), "aliases").withColumnRenamed("form", "alias_form")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, say = longest_rule(host, path, rules)
    judged = slim.join(table, F.col("form") == F.col("alias_form"), "left")
    return judged.select(
        "id", "url", host.alias("host"), path.alias("path"), rule.alias("rule"),
        F.coalesce(say, F.col("alias_verdict"), F.lit("allow")).alias("verdict"), "alias_verdict",
    )
