"""Forms and parts of URLs. Regular expressions rather than parse_url, which has no host for names with an underscore,
letters beyond ASCII, or URLs with spaces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.scalars import text

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def _part(c, i: int) -> Column:
    return F.regexp_extract(F.trim(text(c)), _PARTS, i)


def scheme(c) -> Column:
    return F.lower(_part(c, 1))


def netloc(c) -> Column:
    """With user and port, in lower case."""
    return F.lower(_part(c, 2))


def host(c) -> Column:
    bare = F.regexp_replace(netloc(c), "^.*@", "")
    return F.when(bare.startswith("["), F.regexp_extract(bare, r"^\[([^\]]*)", 1)).otherwise(F.regexp_extract(bare, "^([^:]*)", 1))


def path(c) -> Column:
    return _part(c, 3)


def query(c) -> Column:
    return _part(c, 4)


def origin(c) -> Column:
    return F.regexp_extract(text(c), "^([^/?#]+//[^/?#]*)", 1)


def url_key(c) -> Column:
    """The form that runs are merged by: scheme and host in lower case, no fragment, no final slash, the query as it is. A
    URL without scheme or host stays as it is."""
    bare = F.trim(text(c))
    p = F.regexp_replace(path(c), "/+$", "")
    p = F.when(p == "", F.lit("/")).otherwise(p)
    q = F.when(query(c) != "", F.concat(F.lit("?"), query(c))).otherwise(F.lit(""))
    return F.when((scheme(c) != "") & (netloc(c) != ""), F.concat(scheme(c), F.lit("://"), netloc(c), p, q)).otherwise(bare)


def _form(x: Column, *, decode: bool) -> Column:
    """Of a part of a query: decoded (stray percent signs stand for themselves), or encoded for a form."""
    if decode:
        return F.url_decode(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25"))
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def unquoted(x: Column) -> Column:
    """Percent signs that encode a byte read as what they encode; plus signs and stray percent signs stand for themselves."""
    return F.url_decode(F.replace(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B")))


def crawl_key(c) -> Column:
    """The frontier's form: https, no default port, parameters decoded, sorted and encoded anew, no fragment, no final slash. A
    URL whose host has a stray or odd bracket keeps its form, without final slashes."""
    bare = F.trim(text(c))
    kind, place, way = scheme(c), netloc(c), path(c)
    kind = F.when(kind == "http", F.lit("https")).otherwise(kind)
    name = F.regexp_replace(place, ":(443|80)$", "")
    pairs = F.transform(
        F.filter(F.split(query(c), "&"), lambda x: x != ""),
        lambda x: F.struct(_form(F.substring_index(x, "=", 1), decode=True).alias("k"), _form(F.regexp_replace(x, "^[^=]*=?", ""), decode=True).alias("v")),
    )
    q = F.concat_ws("&", F.transform(F.array_sort(pairs), lambda p: F.concat(_form(p["k"], decode=False), F.lit("="), _form(p["v"], decode=False))))
    way = F.when(way == "", F.lit("/")).otherwise(way)
    rooted = F.when(way.startswith("/"), way).otherwise(F.concat(F.lit("/"), way))
    before = F.when(kind != "", F.concat(kind, F.lit(":"))).otherwise(F.lit(""))
    placed = F.when((name != "") | kind.isin("https", "ftp", "file"), F.concat(F.lit("//"), name, rooted)).otherwise(way)
    whole = F.concat(before, placed, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))
    odd = place.rlike(r"[\[\]]") & ~place.rlike(r"^([^\[\]@]*@)?\[[0-9a-f:.%]+\](:[0-9]*)?$")
    whole = F.when(odd, bare).otherwise(whole)
    short = F.regexp_replace(whole, "/+$", "")
    return F.when(short == "", whole).otherwise(short)


# Schemes whose references are relative to a base.
RELATIVE = ("ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms", "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss")


def _without_dots(segments: Column) -> Column:
    """Segments of a path without `.` and with each `..` taking the one before away, as a fold; the last leaves a final slash."""
    fold = F.aggregate(segments, F.array().cast("array<string>"), lambda kept, s: F.when(s == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).when(s == ".", kept).otherwise(F.concat(kept, F.array(s))))
    return F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(fold, F.array(F.lit("")))).otherwise(fold)


def resolved(link: Column, base: Column) -> Column:
    """A reference against a base, as RFC 3986 has it, but as browsers and crawlers read it: tabs and line ends within are dropped,
    and empty segments between those of a relative path and its base go. A scheme that knows no relative references is left as it
    is. A host with a stray bracket gives a blank."""
    clean = lambda x: F.regexp_replace(F.regexp_replace(x, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\r\n]", "")
    part = lambda x, i: F.regexp_extract(x, _PARTS, i)

    def read(x: Column) -> Column:
        """The parts of both, each found once."""
        return F.struct(
            x["given"].alias("given"), x["base"].alias("base"), F.lower(part(x["link"], 1)).alias("kind"), F.lower(part(x["root"], 1)).alias("own"),
            part(x["link"], 2).alias("place"), part(x["link"], 3).alias("way"), part(x["link"], 4).alias("asked"), F.regexp_extract(x["link"], "(#.*)$", 1).alias("tail"),
            part(x["root"], 2).alias("at"), part(x["root"], 3).alias("path"), part(x["root"], 4).alias("query"),
        )

    both = _bound(F.struct(text(link).alias("given"), text(base).alias("base"), clean(text(link)).alias("link"), clean(text(base)).alias("root")), read)
    return _bound(both, _resolved)


def _bound(value: Column, body) -> Column:
    """body(value), with the value computed, and standing in the plan, once."""
    return F.transform(F.array(value), body)[0]


def _merged(way: Column, path: Column) -> Column:
    """A reference's path laid over its base's: without dots, and of both together without empty segments between the first and
    the last."""
    above = F.regexp_replace(path, "[^/]*$", "")
    laid = F.regexp_replace(F.concat(F.when(above.startswith("/"), "").otherwise("/"), above, way), "/{2,}(?!$)", "/")
    laid = F.when(laid.endswith("//"), F.regexp_replace(laid, "/+$", "/")).otherwise(laid)
    joined = F.when(way.startswith("/"), way).otherwise(laid)
    dots = lambda x: F.when(x.rlike(r"(^|/)[.][.]?(/|$)"), F.array_join(_bound(F.split(x, "/"), _without_dots), "/")).otherwise(x)
    return _bound(_bound(joined, dots), lambda x: F.when(x == "", F.lit("/")).otherwise(x))


def _resolved(x: Column) -> Column:
    # the last segment's parameters are no part of its name
    merged = F.concat(_merged(F.regexp_replace(x["way"], ";[^/]*$", ""), x["path"]), F.regexp_extract(x["way"], "(;[^/]*)$", 1))
    here = x["place"] == ""
    path = F.when(~here, x["way"]).when(x["way"] == "", x["path"]).otherwise(merged)
    asked = F.when(here & (x["way"] == "") & (x["asked"] == ""), x["query"]).otherwise(x["asked"])
    made = _bound(F.struct(F.when(here, x["at"]).otherwise(x["place"]).alias("at"), path.alias("path"), asked.alias("asked")), lambda y: _composed(x["own"], y, x["tail"]))
    stray = F.concat(x["place"], F.lit(" "), x["at"]).rlike(r"\[[^\]]*( |$)|^[^\[]*\]| [^\[]*\]")
    foreign = ((x["kind"] != "") & (x["kind"] != x["own"])) | ~x["own"].isin(*RELATIVE)
    return F.when(x["base"] == "", x["given"]).when(x["given"] == "", x["base"]).when(stray, F.lit("")).when(foreign, x["given"]).otherwise(made)


def _composed(kind: Column, y: Column, tail: Column) -> Column:
    root = F.when((y["path"] != "") & ~y["path"].startswith("/") & (y["at"] != ""), F.lit("/")).otherwise(F.lit(""))
    mark = F.when(y["asked"] != "", F.lit("?")).otherwise(F.lit(""))
    slashes = F.when((y["at"] != "") | (kind == "file"), F.lit("//")).otherwise(F.lit(""))
    return F.concat(kind, F.lit(":"), slashes, y["at"], root, y["path"], mark, y["asked"], tail)


def link_norm(link: Column, base: Column) -> Column:
    """A link resolved against its page, without fragment and final slash; one that is all slashes keeps them."""
    bare = F.regexp_replace(resolved(link, base), "#.*$", "")
    return _bound(bare, lambda x: F.when(F.regexp_replace(x, "/+$", "") == "", x).otherwise(F.regexp_replace(x, "/+$", "")))


# Extensions that are no pages, and their categories.
ASSET_CATEGORIES = {
    ".pdf": "pdf",
    ".jpg": "image",
    ".jpeg": "image",
    ".png": "image",
    ".gif": "image",
    ".svg": "image",
    ".webp": "image",
    ".doc": "office",
    ".docx": "office",
    ".ppt": "office",
    ".pptx": "office",
    ".odt": "office",
    ".xls": "spreadsheet",
    ".xlsx": "spreadsheet",
    ".ods": "spreadsheet",
    ".zip": "archive",
    ".mp3": "audio",
    ".mp4": "video",
    ".woff": "font",
    ".woff2": "font",
    ".ttf": "font",
    ".eot": "font",
    ".css": "stylesheet",
    ".js": "script",
    ".xml": "xml",
    ".json": "json",
    ".atom": "xml",
    ".rss": "xml",
}


def extension(c) -> Column:
    found = F.regexp_extract(F.lower(path(c)), r"(\.[a-z0-9]+)$", 1)
    return F.when(found.isin(*ASSET_CATEGORIES), found).otherwise(F.lit(""))


def asset_category(c) -> Column:
    """Null for what isn't an asset."""
    kinds = F.create_map(*(F.lit(x) for pair in ASSET_CATEGORIES.items() for x in pair))
    return F.try_element_at(kinds, extension(c))


def in_domain(name: Column, domain: str) -> Column:
    """The domain itself or a name below it."""
    return (name == domain.lower()) | name.endswith(f".{domain.lower()}")


def in_scope(c, allow=(), deny=(), without=(), within=()) -> Column:
    """Allowed domains (none: all), then excluded ones, then substrings that exclude, then those of which one is needed."""
    name, low = host(c), F.lower(text(c))
    out = F.lit(True)
    if allow:
        hit = F.lit(False)
        for d in allow:
            hit = hit | in_domain(name, d.lstrip("."))
        out = out & hit
    for d in deny:
        out = out & ~in_domain(name, d)
    for s in without:
        out = out & ~F.contains(low, F.lit(s.lower()))
    if within:
        hit = F.lit(False)
        for s in within:
            hit = hit | F.contains(low, F.lit(s.lower()))
        out = out & hit
    return out
