"""Profiles from where they are: a file, a cache, or a provider that makes them.

A provider is a function from a DataFrame of inputs to `key` and the nine columns of a profile; `PROVIDERS` holds
those that can be named. The word lists' heuristics are one; others (a service, a model) can be put beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import vocabulary as v
from cadenza.functions.text import compact_key
from cadenza.operators import profiles
from cadenza.sources import readers, sinks

#: Fixed value: the version that cache keys begin with.
VERSION = "fine_keywords_v1"
Provider = Callable[[DataFrame], DataFrame]
PROVIDERS: dict[str, Provider] = {"heuristic": profiles.song_profiles}


def song_profiles(spark: SparkSession, songs: DataFrame, csv: str | None = None, provider: str = "heuristic") -> DataFrame:
    """song_id and a profile for every song: from the CSV, else from the provider."""
    if csv is None or not readers.exists(spark, csv):
        return PROVIDERS[provider](songs)
    given = readers.read_song_profiles(spark, csv, songs)
    rest = songs.join(given.select("song_id"), "song_id", "left_anti")
    return given.select("song_id", *v.KEYS).unionByName(PROVIDERS[provider](rest).select("song_id", *v.KEYS))


def cached(inputs: DataFrame, key: str, name: Column, path: str, provider: Provider, fallback: Provider | None = None, most: int = 0, force: bool = False) -> DataFrame:
    """`key` and the nine columns for every row of `inputs`: reused from the cache at `path` (by `name`), else made
    by `provider` and appended to the cache. If `most` isn't 0, only so many are made, the first by key, and
    `fallback` makes the others, which aren't kept. `force` makes all anew."""
    spark = inputs.sparkSession
    rows = inputs.withColumn("__name", name)
    missing = rows
    if not force and readers.exists(spark, path):
        have = readers.read_cache(spark, path).select(F.col("cache_key").alias("__name"))
        missing = rows.join(have, "__name", "left_anti")
    first = missing.select(key).distinct().orderBy(key).limit(most) if most else None
    made = missing if first is None else missing.join(first, key, "left_semi")
    records = provider(made.drop("__name")).join(made.select(key, "__name"), key)
    sinks.append_cache(records.select(F.col("__name").alias("cache_key"), *v.KEYS), path)
    now = readers.read_cache(spark, path).withColumnRenamed("cache_key", "__name")
    out = rows.select(key, "__name").join(now, "__name").select(key, *v.KEYS)
    if first is None:
        return out
    # what was missing before this run and wasn't made in it
    capped = missing.join(first, key, "left_anti").drop("__name")
    return out.join(capped.select(key), key, "left_anti").unionByName((fallback or provider)(capped).select(key, *v.KEYS))


def cached_songs(songs: DataFrame, path: str, provider: str = "heuristic", most: int = 0, force: bool = False) -> DataFrame:
    """Profiles of songs through a cache."""
    return cached(songs, "song_id", compact_key(F.lit(VERSION), F.lit("song"), F.col("song_id")), path, PROVIDERS[provider], profiles.song_profiles, most, force)


def cached_playlists(split: DataFrame, songs: DataFrame, path: str, provider: Provider | None = None, most: int = 0, force: bool = False) -> DataFrame:
    """Profiles of cases through a cache, by the playlist's id and its observed items; the heuristics' unless there is a provider, which is
    given case_idx and playlist_id."""
    by_words = lambda cases: profiles.playlist_profiles(split.join(cases.select("case_idx"), "case_idx", "left_semi"), songs)
    observed = F.transform(F.sort_array(F.collect_list(F.struct("rn", "song_id"))), lambda x: x["song_id"])
    cases = split.where("observed").groupBy("case_idx", F.col("playlist_id").cast("string").alias("playlist_id")).agg(observed.alias("observed"))
    return cached(cases, "case_idx", compact_key(F.lit(VERSION), F.col("playlist_id"), F.col("observed")), path, provider or by_words, by_words, most, force)
