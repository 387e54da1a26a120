"""Text nodes of HTML pages, and pages with their text nodes replaced.

A page is cut into tokens: comments, scripts, styles, tags and text. Regular markup needs no parser in Python; the tokens
keep every character, so a page without replaced nodes comes back as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossloom.functions.predicates import is_translatable_doc
from glossloom.functions.text import trim
from glossloom.operators.render import put_back, view_text

TOKEN = "(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<[^>]*>|[^<]+|<"
SPACE = "[ \\t\\n\\x0B\\f\\r]"
# Entities that text nodes are decoded from, the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def decode_entities(s: Column) -> Column:
    for a, b in ENTITIES:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def with_tokens(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key and tokens, as a column of its own, so that the pages are cut once. An empty page is one empty token."""
    found = F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))
    return pages.select(key, F.when(F.col(html) == "", F.array(F.lit(""))).otherwise(found).alias("tokens"))


def nodes(target: str) -> Column:
    """(node, text, original) of the tokens that are units; node is the token's number, original the trimmed text. Only what
    follows <body counts, if there is one."""
    numbered = F.transform("tokens", lambda t, i: F.struct(i.alias("node"), t.alias("tok")))
    body = F.coalesce(F.array_position(F.transform("tokens", lambda t: t.rlike("(?i)^<body\\b")), True).cast("int"), F.lit(0))
    # the place of <body is worked out once a page
    inside = F.flatten(F.transform(F.array(body), lambda b: F.filter(numbered, lambda n: (n["node"] >= b) & ~n["tok"].startswith("<"))))
    text = F.transform(inside, lambda n: F.struct(n["node"].alias("node"), trim(decode_entities(n["tok"])).alias("original")))
    return F.filter(text, lambda n: is_translatable_doc(n["original"], target, trimmed=True))


def html_units(pages: DataFrame, key: str = "file", html: str = "html", target: str = "zh-CN") -> DataFrame:
    """key, seq (dense, of accepted nodes), node, original. A null page has no units."""
    rows = with_tokens(pages, key, html).select(key, F.posexplode_outer(nodes(target)).alias("seq", "n")).filter(F.col("n").isNotNull())
    return rows.select(key, "seq", "n.node", "n.original")


def rebuild_html(pages: DataFrame, units: DataFrame, mode: str = "translated", key: str = "file", html: str = "html") -> DataFrame:
    """key, html with the units' nodes replaced by their view, escaped. ASCII space around a node's text stays. Null pages
    stay null. Tokens and units are dealt by page once and put together there."""
    safe = view_text(F.col("original"), F.col("translated"), mode)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    pieces = with_tokens(pages, key, html).select(key, F.posexplode_outer("tokens").alias("at", "piece"))
    new = units.select(key, F.col("node").cast("int").alias("at"), safe.alias("new"))
    around = F.concat(F.regexp_extract("piece", f"^{SPACE}*", 0), F.col("new"), F.regexp_extract("piece", f"{SPACE}*\\z", 0))
    return put_back(pieces, new, key, "at", ["piece"], ["new"], F.when(F.col("new").isNull(), F.col("piece")).otherwise(around), "", html)
