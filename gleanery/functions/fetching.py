"""What decides whether, when and how a URL is fetched, as expressions: media types, the choice between raw and rendered HTML,
literal addresses, delays, deferrals and the frontier's order."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanery.functions import urls
from gleanery.functions.scalars import text

#: A body below this is thin, and rendered where that gives more.
THIN = 2_000
#: Score that a deferred URL takes on, and how often it may be deferred.
BUMP, MOST_DEFERRALS = 1_000_000.0, 12


def probably_html(content_type) -> Column:
    """Of a media type; an absent one counts as HTML."""
    kind = F.lower(text(content_type))
    return (kind == "") | F.contains(kind, F.lit("text/html")) | F.contains(kind, F.lit("application/xhtml"))


def chosen_html(html, rendered) -> Column:
    """The rendered HTML where the raw is thin and the rendered holds more; else the raw."""
    raw, other = F.length(F.trim(text(html))), F.length(F.trim(text(rendered)))
    return F.when((text(html) != "") & (raw < THIN) & (other > raw), text(rendered)).otherwise(text(html))


def pages(captures: DataFrame) -> DataFrame:
    """Captures that are pages: url, html (the one to parse), headers, and what else the fetcher noted. A URL that was moved goes by
    its final address."""
    kept = captures.where(probably_html("content_type") & F.col("html").isNotNull())
    moved = F.when(F.trim(text("final_url")) != "", F.col("final_url")).otherwise(F.col("url"))
    return kept.select(moved.alias("url"), F.col("url").alias("requested_url"), "http_status", "content_type", chosen_html("html", "rendered_html").alias("html"), "headers", "fetch_time_ms", "fetched_at")


# Networks that aren't fetched from.
BLOCKED = tuple(ipaddress.ip_network(n) for n in ("0.0.0.0/8", "127.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "192.0.0.0/24", "192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4"))
BLOCKED_6 = tuple(ipaddress.ip_network(n) for n in ("100::/64", "2001:db8::/32", "fc00::/7"))
MAPPED = tuple(ipaddress.ip_network(n) for n in ("::ffff:0:0/96", "64:ff9b::/96"))


def allowed_address(address: ipaddress.IPv4Address | ipaddress.IPv6Address) -> bool:
    """Whether an address is of the public web."""
    if address.version == 4:
        return not (address.is_multicast or address.is_reserved or address.is_link_local or any(address in n for n in BLOCKED))
    if address.is_loopback or address.is_link_local or address.is_multicast or address.is_private:
        return False
    if any(address in n for n in MAPPED):
        return allowed_address(ipaddress.IPv4Address(int(address) & 0xFFFFFFFF))
    return not any(address in n for n in BLOCKED_6) and int(address) >= 1 << 32


def _address(name: str) -> str:
    try:
        address = ipaddress.ip_address(name.split("%", 1)[0])
    except ValueError:
        return ""
    return "" if allowed_address(address) else f"blocked address {address}"


def _addresses(names: pd.Series) -> pd.Series:
    return names.map(lambda n: _address(n or ""))


def blocked(c) -> Column:
    """Why a URL isn't fetched, or null. Names aren't resolved."""
    bare, kind, name = F.trim(text(c)), urls.scheme(c), F.regexp_replace(urls.host(c), "[.]$", "")
    # few rows hold addresses, so the vectorised function gets blanks for the others
    literal = F.when(name.rlike("^[0-9.]+$|:"), name).otherwise(F.lit(""))
    found = F.pandas_udf(_addresses, "string")(literal)
    return (
        F.when(bare == "", F.lit("empty URL"))
        .when(~kind.isin("http", "https"), F.concat(F.lit("unsupported scheme '"), kind, F.lit("'")))
        .when(name == "", F.lit("missing host"))
        .when(found != "", found)
    )


def delay(base: Column, failures: Column) -> Column:
    """Seconds before a host's next fetch: more with each failure in a row, up to a minute."""
    return base + F.when(failures > 0, F.least(base * F.pow(F.lit(2.0), F.least(failures, F.lit(5))), F.lit(60.0))).otherwise(F.lit(0.0))


def spacing(per_minute: Column) -> Column:
    """Seconds between requests that a limit per minute implies."""
    return 60.0 / F.greatest(F.lit(1), per_minute)


def after_503(score: Column, deferrals: Column) -> tuple[Column, Column]:
    """Of a URL that was answered 503, and deferred so often before: the score it is queued with again, null where it isn't; and
    whether it becomes an error."""
    over = deferrals >= MOST_DEFERRALS
    return F.when(~over, score + BUMP), over


def failures_in_a_row(fetches: DataFrame, host: str, order: str, failed: str) -> DataFrame:
    """host and failures: how many of a host's fetches failed since its last success. Two aggregates, combined before the
    shuffle; no host's fetches are sorted."""
    good = fetches.where(~F.col(failed)).groupBy(host).agg(F.max(order).alias("_last"))
    since = fetches.where(failed).join(good, host, "left").where(F.col("_last").isNull() | (F.col(order) > F.col("_last")))
    return fetches.select(host).distinct().join(since.groupBy(host).agg(F.count("*").alias("failures")), host, "left").fillna(0, ["failures"])


def next_batch(frontier: DataFrame, n: int, busy: DataFrame | None = None, one_a_host: bool = True) -> DataFrame:
    """The next n of a frontier (url, score, seq): the least scores, of equal ones the first queued. With one_a_host, one of each
    host at most, and none of the hosts in `busy` (column host); URLs without a host don't exclude one another."""
    if not one_a_host:
        return frontier.orderBy("score", "seq").limit(n)
    keyed = frontier.withColumn("_h", urls.host("url"))
    if busy is not None:
        keyed = keyed.join(busy.select(F.col("host").alias("_h")).where("_h <> ''").distinct(), "_h", "left_anti")
    own = F.when(F.col("_h") == "", F.concat(F.lit("#"), F.col("seq").cast("string"))).otherwise(F.col("_h"))
    first = F.row_number().over(Window.partitionBy("_o").orderBy("score", "seq"))
    return keyed.withColumn("_o", own).withColumn("_k", first).where("_k = 1").orderBy("score", "seq").limit(n).drop("_h", "_o", "_k")


def sample_links(parsed: DataFrame, n: int, url: str = "url") -> DataFrame:
    """From a homepage's parsed edges, breadth-first: url (the page itself first) and place of n addresses of its own netloc that
    lead to no file, in the order of the page."""
    own = urls.netloc(url)
    fit = F.filter("edges", lambda e: (urls.netloc(e["to_url"]) == own) & (urls.extension(e["to_url"]) == ""))
    found = F.array_distinct(F.concat(F.array(F.regexp_replace(F.col(url), "/+$", "")), F.transform(fit, lambda e: e["to_url"])))
    return parsed.select(F.col(url).alias("page"), F.posexplode(F.slice(found, F.lit(1), F.lit(n))).alias("place", "url"))
