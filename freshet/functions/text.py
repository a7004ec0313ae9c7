"""Station codes and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CODE_WIDTH = 10
MIN_FRAGMENT = 5

# Accepted spellings of the metropolitan municipalities.
VALLEY_MUNICIPALITIES = [
    "medellin", "medellín", "bello", "itagui", "itagüi", "itagüí", "envigado", "sabaneta",
    "la estrella", "caldas", "copacabana", "girardota", "barbosa",
]


def upper_text(value: Column) -> Column:
    return F.coalesce(F.upper(F.trim(value)), F.lit(""))


def lower_text(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)), F.lit(""))


def bare_code(code: Column) -> Column:
    """Code without leading zeros, so that 0027 and 27 are one station."""
    return F.ltrim(code.cast("string"), F.lit("0"))


def padded_code(code: Column) -> Column:
    text = code.cast("string")
    return F.when(F.length(text) < CODE_WIDTH, F.lpad(text, CODE_WIDTH, "0")).otherwise(text)


def code_variants(code: Column) -> Column:
    """Spellings under which a source may publish a code: as given, bare, padded."""
    given = F.trim(code.cast("string"))
    spellings = F.array_distinct(F.array(given, bare_code(given), padded_code(given)))
    return F.filter(spellings, lambda s: s.isNotNull() & (s != ""))


def name_fragments(name: Column) -> Column:
    """Distinct dash-separated parts of a station name, long enough to identify it."""
    head = F.split_part(upper_text(name), F.lit("["), F.lit(1))
    parts = F.transform(F.split(head, "-"), lambda p: F.trim(p))
    return F.array_distinct(F.filter(parts, lambda p: F.length(p) >= MIN_FRAGMENT))
