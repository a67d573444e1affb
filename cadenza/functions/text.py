"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_text(c: Column) -> Column:
    """Lower case without bracketed parts; everything but a-z and 0-9 becomes one space; trimmed; null is ''."""
    bare = F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), r"\([^)]*\)|\[[^\]]*\]", " ")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def song_key(title: Column, artist: Column) -> Column:
    """The key of an item: its normalised artist and title ('::' where both come to nothing)."""
    return F.concat(normalize_text(artist), F.lit("::"), normalize_text(title))


def normalized_artist(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty, else ''."""
    return F.coalesce(*(F.when(c != "", c) for c in columns), F.lit(""))


def percent_text(part: Column, whole: Column) -> Column:
    """`12.34%`; 0 of 0 is 0.00%."""
    return F.format_string("%.2f%%", F.coalesce(F.try_divide(F.lit(100.0) * part, whole), F.lit(0.0)))


def length_bin(n: Column) -> Column:
    """0, 1-10, 11-20, ..., 91-100, 100+."""
    tens = (F.ceil(n / 10).cast("int") - 1) * 10
    return F.when(n <= 0, "0").when(n > 100, "100+").otherwise(F.concat_ws("-", (tens + 1).cast("string"), (tens + 10).cast("string")))


def squeeze(c: Column) -> Column:
    """Runs of white space become one space."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def excerpt(c: Column, chars: int) -> Column:
    """The squeezed text, cut to `chars` and back to its last space if it is longer."""
    text = squeeze(c)
    return F.when(F.length(text) > chars, F.regexp_replace(F.substring(text, 1, chars), " [^ ]*$", "")).otherwise(text)


def cache_key(*parts: Column) -> Column:
    """SHA-1 of the parts as a JSON array of strings."""
    quoted = [F.to_json(F.struct(F.coalesce(p.cast("string"), F.lit("")).alias("v"))) for p in parts]
    items = [F.regexp_extract(q, r'(?s)^\{"v":(.*)\}$', 1) for q in quoted]
    return F.sha1(F.concat(F.lit("["), F.concat_ws(", ", *items), F.lit("]")))


def compact_key(*parts: Column) -> Column:
    """SHA-1 of the parts, strings or arrays of strings, as a JSON array without spaces."""
    as_json = lambda p: F.regexp_extract(F.to_json(F.struct(p.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return F.sha1(F.concat(F.lit("["), F.concat_ws(",", *map(as_json, parts)), F.lit("]")))
