"""Scalar helpers: formats, time text and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compact(value: Column) -> Column:
    """1234567 as 1.23M; K, M, B from a thousand up, halves away from zero."""
    a = F.abs(value)
    part = lambda by, digits, unit: F.concat(F.round(value / by, digits).cast("string"), F.lit(unit))
    return F.when(a >= 1e9, part(1e9, 2, "B")).when(a >= 1e6, part(1e6, 2, "M")).when(a >= 1e3, part(1e3, 1, "K")).otherwise(F.round(value, 0).cast("long").cast("string"))


def signed_percent(value: Column) -> Column:
    return F.when(value.isNull(), "n/a").otherwise(F.concat(F.when(value > 0, "+").otherwise(""), F.format_string("%.2f%%", value.cast("double"))))


def reduction_percent(source: Column, target: Column) -> Column:
    """How much smaller the target is, in percent of the source, from exact decimals; null for a source of 0."""
    s, t = source.cast("decimal(38,0)"), target.cast("decimal(38,0)")
    return F.when(s != 0, ((s - t).cast("decimal(38,6)") * 100 / s).cast("double"))


def thousands(value: Column) -> Column:
    """1234567 as 1,234,567."""
    return F.format_number(value.cast("double"), 0)


def arrow(change: Column) -> Column:
    """An arrow down, up or sideways; null for an unknown change."""
    return F.when(change < 0, "\u2193").when(change > 0, "\u2191").when(change == 0, "\u2192")


def preview(text: Column, length: int) -> Column:
    """A text's first characters, with an ellipsis if there are more."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("\u2026"))).otherwise(text)


def direction(change: Column) -> Column:
    return F.when(change > 0, "up").when(change < 0, "down").when(change == 0, "flat")


def iso_instant(text: Column) -> Column:
    """Timestamp of an ISO text with an offset or Z; null without one: no zone is assumed."""
    return F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00")))


def number_token(raw: Column, key: str) -> Column:
    """A JSON number exactly as it is written."""
    return F.nullif(F.regexp_extract(raw, rf'"{key}"\s*:\s*(-?[0-9][0-9.eE+-]*)', 1), F.lit(""))


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))
