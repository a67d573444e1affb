"""How much one artist dominates a playlist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.text import normalized_artist


def playlist_stats(tracks: DataFrame, artist: str = "artist", dominated: float = 0.5, diverse: float = 0.4, least_artists: int = 5, least_tracks: int = 20) -> DataFrame:
    """A row for each playlist that has artists: the top artist (the first that occurs of equal ones) and its
    share, distinct artists and tracks, and two flags. Repeated tracks count once."""
    one = (
        tracks.withColumn("a", normalized_artist(F.col(artist)))
        .where("a != '' and cast(playlist_id as string) != ''")
        .groupBy("playlist_id", "song_id")
        .agg(F.min(F.struct("pos", "a")).alias("x"), F.count("*").alias("rows"))
    )
    by_artist = one.groupBy("playlist_id", F.col("x.a").alias("a")).agg(F.count("*").alias("n"), F.min("x.pos").alias("first"), F.sum("rows").alias("rows"))
    best = F.max_by("a", F.struct("n", -F.col("first")))
    by = by_artist.groupBy("playlist_id").agg(
        F.sum("rows").alias("input_row_count"), best.alias("top_artist"), F.max("n").alias("top_artist_count"), F.count("*").alias("unique_artist_count"), F.sum("n").alias("deduped_track_count")
    )
    share = F.col("top_artist_count") / F.col("deduped_track_count")
    return by.select(
        "*",
        F.format_string("%.6f", share).alias("top_artist_share"),
        (share >= dominated).cast("int").alias("is_artist_dominated"),
        ((F.col("deduped_track_count") >= least_tracks) & (share <= diverse) & (F.col("unique_artist_count") >= least_artists)).cast("int").alias("is_diverse"),
    )


def diverse_rows(tracks: DataFrame, stats: DataFrame) -> DataFrame:
    """The rows of diverse playlists with their playlist's statistics, which replace columns of their name."""
    own = [c for c in tracks.columns if c not in stats.columns or c == "playlist_id"]
    return tracks.select(*own).join(stats.where("is_diverse = 1"), "playlist_id")


def split_cases(split: DataFrame, songs: DataFrame, dominated: float = 0.5, diverse: float = 0.4, least_artists: int = 5) -> DataFrame:
    """Artist share of each case over observed and held-out items together, by the artist as written."""
    by = split.join(songs.select("song_id", "artist"), "song_id").groupBy("case_idx", "playlist_id", "artist").agg(F.count("*").alias("n"))
    by = by.groupBy("case_idx", "playlist_id").agg((F.max("n") / F.sum("n")).alias("top_share"), F.count("*").alias("unique_artists"))
    return by.select(
        "case_idx",
        "playlist_id",
        F.round("top_share", 6).alias("top_share"),
        "unique_artists",
        (F.col("top_share") >= dominated).alias("dominated"),
        ((F.col("top_share") <= diverse) & (F.col("unique_artists") >= least_artists)).alias("diverse"),
    )
