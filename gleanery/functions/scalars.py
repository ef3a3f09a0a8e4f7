"""Cells are strings; these parse and measure them as reports need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(c: str | Column) -> Column:
    """A cell; absent counts as blank."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def filled(c: str | Column) -> Column:
    return F.trim(text(c)) != ""


def as_int(c: str | Column, default: int = 0) -> Column:
    """An integer cell; anything else is the default. `12.0` and `1_000` aren't integers."""
    return F.coalesce(F.when(F.trim(text(c)).rlike("^[+-]?[0-9]+$"), F.trim(text(c)).try_cast("long")), F.lit(default).cast("long"))


def as_float(c: str | Column, default: float = 0.0) -> Column:
    """A number cell; Java's suffixes d and f aren't numbers here."""
    return F.coalesce(F.when(~F.trim(text(c)).rlike("[dDfF]$") | F.lower(F.trim(text(c))).rlike("inf$"), F.trim(text(c)).try_cast("double")), F.lit(default))


def rounded(x: Column, places: int = 1) -> Column:
    """Half to even on the scaled double. It differs from decimal rounding only where a half isn't exact in binary."""
    scale = float(10**places)
    return F.rint(x * scale) / scale


def share(part: Column, whole: Column, places: int = 1) -> Column:
    """A percentage, 0 of nothing."""
    return F.when(whole > 0, rounded(part / whole * 100, places)).otherwise(F.lit(0.0))


def parts(c: str | Column, mark: str = "[|]") -> Column:
    """The filled parts of a piped list, trimmed."""
    return F.filter(F.transform(F.split(text(c), mark), lambda x: F.trim(x)), lambda x: x != "")


_MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def norm_date(c: str | Column) -> Column:
    """YYYY-MM-DD of an ISO or RFC-2822 date, or of the first such stretch; null without one. Offsets aren't applied."""
    x = F.trim(text(c))
    iso = F.regexp_extract(x, "([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    pattern = "^[A-Za-z]{3}, ([0-9]{1,2}) ([A-Za-z]{3}) ([0-9]{4}) [0-9]{2}:[0-9]{2}:[0-9]{2}"
    month = F.array_position(F.array(*map(F.lit, _MONTHS)), F.initcap(F.regexp_extract(x, pattern, 2)))
    mail = F.concat_ws("-", F.regexp_extract(x, pattern, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(x, pattern, 1), 2, "0"))
    return F.when(iso != "", iso).when(month > 0, mail)


def year(c: str | Column) -> Column:
    found = F.regexp_extract(text(c), "((?:19|20)[0-9]{2})", 1)
    return F.when(found != "", found.cast("int"))


def sanitised(c: str | Column, most: int | None = 32_000) -> Column:
    """A cell as it is written for interchange: no NULs, and with `most` long ones cut, with a mark that says so."""
    x = F.replace(text(c), F.lit("\0"), F.lit(""))
    return x if most is None else F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit("…[truncated]"))).otherwise(x)


def slug(c: str | Column) -> Column:
    """A name for a folder: lower case, other characters as single hyphens, 60 at most; blank where nothing is left."""
    x = F.regexp_replace(F.regexp_replace(F.trim(F.lower(text(c))), "[^a-z0-9-]", "-"), "-{2,}", "-")
    return F.substring(F.regexp_replace(x, "^-+|-+$", ""), 1, 60)


def content_hash(c: str | Column) -> Column:
    return F.substring(F.sha2(text(c).cast("binary"), 256), 1, 16)


def occurrences(c: Column, term: Column) -> Column:
    """Of a literal, not overlapping, whatever the case."""
    low, key = F.lower(c), F.lower(term)
    return F.when(F.length(key) > 0, ((F.length(low) - F.length(F.replace(low, key, F.lit("")))) / F.length(key)).cast("long")).otherwise(F.lit(0).cast("long"))
