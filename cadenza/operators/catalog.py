"""The item catalog: which rows are usable, and one row for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filled(name: str) -> Column:
    return F.length(F.trim(F.coalesce(F.col(name), F.lit("")))) > 0


def usable(rows: DataFrame) -> DataFrame:
    """Rows that have a title, an artist and lyrics."""
    return rows.where(filled("title") & filled("artist") & filled("lyrics"))


def first_wins(rows: DataFrame, *more: str) -> DataFrame:
    """One row for each song_id, the first by `ord` (an aggregate: combined before it is shuffled). Each column is an
    aggregate of its own, so that lyrics that aren't asked for aren't carried. `more`: further columns to keep."""
    best = usable(rows).groupBy("song_id").agg(*(F.min_by(c, "ord").alias(c) for c in ("title", "artist", "lyrics", *more)))
    return best.select("song_id", *(F.trim(c).alias(c) for c in ("title", "artist", "lyrics")), *more)


def scan_stats(rows: DataFrame) -> DataFrame:
    """Counts of rows, of what they have, and of usable rows that repeat a key."""
    has = {n: filled(n) for n in ("title", "artist", "lyrics")}
    every = has["title"] & has["artist"] & has["lyrics"]
    return rows.agg(
        F.count("*").alias("n_rows"),
        *(F.count_if(c).alias(f"has_{n}") for n, c in has.items()),
        F.count_if(has["title"] & has["artist"]).alias("has_title_artist"),
        F.count_if(every).alias("usable_rows"),
        F.count_distinct(F.when(every, F.col("song_id"))).alias("unique_keys"),
    ).withColumn("duplicate_usable_keys", F.col("usable_rows") - F.col("unique_keys"))


def duplicate_keys(rows: DataFrame) -> DataFrame:
    return usable(rows).groupBy("song_id").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord")).where("n > 1")
