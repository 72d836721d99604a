"""Coercions and fallbacks. Every function takes columns and gives a column; none runs Python for a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def int_or(c: Column, default: int | None = None) -> Column:
    """A long; what is null or no integer becomes default."""
    return F.coalesce(c.try_cast("long"), F.lit(default).cast("long"))


def int_or_zero(c: Column) -> Column:
    """A long; null and the empty string become 0, as does what is no integer."""
    return int_or(c, 0)


def text_or_null(c: Column) -> Column:
    return c.cast("string")


def text_list(df: DataFrame, name: str) -> Column:
    """An array of strings: null becomes an empty one, a single value an array of it."""
    c = F.col(name)
    if df.schema[name].dataType.typeName() == "array":
        return F.coalesce(F.transform(c, lambda x: x.cast("string")), F.array().cast("array<string>"))
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.array(c.cast("string")))


def list_or_empty(c: Column, element: str = "string") -> Column:
    return F.coalesce(c, F.array().cast(f"array<{element}>"))


def timestamp_or_null(c: Column) -> Column:
    """A timestamp from ISO 8601 text; null if it is none."""
    return F.try_to_timestamp(c)


def null_or(first: Column, second: Column) -> Column:
    """second only where first is null; an empty string stays."""
    return F.coalesce(first, second)


def falsy_or(first: Column, second: Column) -> Column:
    """second where first is null or the empty string."""
    return F.coalesce(F.nullif(first, F.lit("")), second)


def truthy_id(c: Column) -> Column:
    """Whether an id counts: neither null nor 0."""
    return F.coalesce(c, F.lit(0)) != 0


def ids_of_digits(c: Column) -> Column:
    """The id in a string of digits only; null for any other."""
    return F.when(c.cast("string").rlike("^[0-9]+$"), c.try_cast("long"))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def spaced_title(c: Column) -> Column:
    return F.translate(c, "_", " ")


def plain_description(c: Column) -> Column:
    """Line breaks of HTML as line feeds; empty becomes null."""
    return F.replace(F.nullif(c, F.lit("")), F.lit("<br/>"), F.lit("\n"))


def detail_url(base: str, list_id: Column, data_type: Column) -> Column:
    page = F.when(data_type == "API", F.lit("openapi.do")).otherwise(F.lit("fileData.do"))
    return F.concat(F.lit(base.rstrip("/") + "/"), list_id.cast("string"), F.lit("/"), page)


def iso(c: Column) -> Column:
    """ISO 8601 text: microseconds only where there are any; null stays null."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(micros.endswith(".000000"), whole).otherwise(micros)


def to_kst(utc: Column) -> Column:
    """Wall-clock time at UTC+9 of a UTC time."""
    return F.from_utc_timestamp(utc, "+09:00")


def to_utc(kst: Column) -> Column:
    return F.to_utc_timestamp(kst, "+09:00")


def hours_since(c: Column, as_of: Column) -> Column:
    """Hours from c to as_of, at least 1; a time without zone counts as UTC."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return F.greatest(F.lit(1.0), (micros(as_of) - micros(c)) / 3.6e9)


def trending_score(popularity: Column, seen: Column, as_of: Column) -> Column:
    """log(1 + popularity) decayed by the hours since seen to the power 1.5."""
    return F.log1p(F.greatest(F.lit(0.0), popularity.cast("double"))) / F.pow(hours_since(seen, as_of), F.lit(1.5))


def percent(part: Column, whole: Column) -> Column:
    """part in whole, in percent; 0 where whole is 0."""
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def plus_days(c: Column, days: int) -> Column:
    return c + F.make_interval(days=F.lit(days))


def first_elements(c: Column, n: int) -> Column:
    return F.slice(c, 1, n)
