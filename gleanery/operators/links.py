"""Links of pages by patterns, in expressions: anchors are found, their addresses resolved and their texts read in the JVM.

Comments, scripts, styles and templates hold no links. An anchor ends at its end tag, or where the next begins. Attributes may be
quoted or bare, with `>` in quotes; entities are read in addresses and texts, those of HTML 4 by name and any by number. Navigation is
what nav elements hold, then elements in that role, each up to the first end tag of its name: of elements of one name within one
another only the outer's first part counts, where `html.Page`, which builds a tree, has it all.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import urls
from gleanery.functions.scalars import text

_INSIDE = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
UNSEEN = r"(?is)<!--.*?-->|<(script|style|template)\b.*?</\1\s*>"
ANCHOR = rf"(?is)<a(?=[\s>/])({_INSIDE})>(.*?)(?=</a\s*>|<a[\s>]|\z)"
NAV = rf"(?is)<nav(?=[\s>/]){_INSIDE}>(.*?)(?=</nav\s*>|\z)"
ROLE = rf"""(?is)<([a-z][a-z0-9]*+)(?=\s[^>]*?(?<=\s)role\s*=\s*["']?navigation["'\s>/]){_INSIDE}>(.*?)(?=</\1\s*>|\z)"""
_NAMES = json.dumps({name: chr(code) for name, code in name2codepoint.items()})
_ENTITY = r"&#?[A-Za-z0-9]+;?|[^&]+|&"


def attribute(inside: Column, name: str) -> Column:
    """An attribute's value; blank for none."""
    found = [F.regexp_extract(inside, rf"""(?is)(?:^|[\s"'/]){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", i) for i in (1, 2, 3)]
    return unescaped(F.concat(*found))


def unescaped(x: Column) -> Column:
    names = F.from_json(F.lit(_NAMES), "map<string,string>")  # a constant, made once by the optimiser

    def read(piece: Column) -> Column:
        digits = F.regexp_extract(piece, "^&#([0-9]+)", 1)
        hexadecimal = F.regexp_extract(piece, "(?i)^&#x([0-9a-f]+)", 1)
        code = F.when(digits != "", digits.try_cast("long")).when(hexadecimal != "", F.conv(hexadecimal, 16, 10).try_cast("long"))
        sane = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        of_code = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        named = F.try_element_at(names, F.regexp_extract(piece, "^&([A-Za-z0-9]+);", 1))
        return F.when(piece.startswith("&"), F.coalesce(F.when(sane, of_code), F.when(code.isNotNull(), F.lit("�")), named, piece)).otherwise(piece)

    def whole(x: Column) -> Column:
        return F.when(F.contains(x, F.lit("&")), F.array_join(F.transform(F.regexp_extract_all(x, F.lit(_ENTITY), F.lit(0)), read), "")).otherwise(x)

    return F.transform(F.array(x), whole)[0]  # so that x stands in the plan once


def plain(fragment: Column) -> Column:
    """The text of a stretch of HTML, the ends stripped."""
    return F.regexp_replace(unescaped(F.regexp_replace(fragment, r"(?s)</?[A-Za-z][^>]*>", "")), r"(?U)^\s+|\s+$", "")


def _anchors(html: Column) -> Column:
    """href and text of each anchor with an address."""
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1)).alias("a"), F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2)).alias("t"))
    given = F.transform(pairs, lambda x: F.struct(F.trim(attribute(x["a"], "href")).alias("href"), x["t"].alias("inner"), x["a"].rlike(r"(?i)(^|[\s\"'/])href\s*=").alias("there")))
    return F.filter(given, lambda x: x["there"])


def seen(html) -> Column:
    return F.regexp_replace(text(html), UNSEEN, "")


def edges(captures: DataFrame, url: str = "url", html: str = "html", allow: Sequence[str] = ()) -> DataFrame:
    """from_url, to_url, link_text of every link to a host in scope."""
    found = captures.select(F.col(url).alias("from_url"), seen(html).alias("_h")).select("from_url", F.explode(_anchors(F.col("_h"))).alias("x"))
    href = F.col("x.href")
    rows = found.where((href != "") & ~href.rlike("(?s)^(#|mailto:|javascript:)") & ~F.lower(href).startswith("tel:"))
    out = rows.select("from_url", urls.link_norm(href, F.col("from_url")).alias("to_url"), plain(F.col("x.inner")).alias("link_text"))
    return out.where((F.col("to_url") != "") & urls.in_scope("to_url", allow))


def nav_links(captures: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """page_url, nav_href, nav_text of every address that a page's navigation has, once."""
    regions = F.concat(F.regexp_extract_all("_h", F.lit(NAV), F.lit(1)), F.regexp_extract_all("_h", F.lit(ROLE), F.lit(2)))
    found = captures.select(F.col(url).alias("page_url"), seen(html).alias("_h")).select("page_url", F.flatten(F.transform(regions, _anchors)).alias("_l"))
    hrefs = found.select("page_url", "_l", F.transform("_l", lambda x: x["href"]).alias("_n"))
    once = hrefs.select("page_url", F.explode(F.filter("_l", lambda x, i: F.array_position("_n", x["href"]) == i + 1)).alias("x"))
    to = urls.link_norm(F.col("x.href"), F.col("page_url"))
    return once.select("page_url", F.when(to == "", F.col("x.href")).otherwise(to).alias("nav_href"), F.substring(plain(F.col("x.inner")), 1, 200).alias("nav_text"))
