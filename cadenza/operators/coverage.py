"""How much of the playlists the catalog covers, and the filters on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.text import length_bin, percent_text

# The steps and filters that results are counted by.
MATCHED_STEPS = (1, 5, 10, 20, 30, 50, 100)
COVERAGE_STEPS = (0.1, 0.2, 0.3, 0.5, 0.7, 0.9, 1.0)
#: The filters on (matched, percent): both, songs, percent.
FILTERS = {
    "50_50": "matched_song_count >= 50 and matched_coverage_percent >= 50",
    "50_songs": "matched_song_count >= 50",
    "50_percent": "matched_coverage_percent >= 50",
}


def marked_tracks(tracks: DataFrame, songs: DataFrame) -> DataFrame:
    """Tracks with `matched`: whether the catalog has their key."""
    keys = songs.select("song_id").distinct().withColumn("matched", F.lit(True))
    return tracks.join(keys, "song_id", "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def per_playlist(marked: DataFrame) -> DataFrame:
    """Tracks, matched tracks and the whole percent of each playlist."""
    by = marked.groupBy("playlist_id").agg(F.count("*").alias("original_track_count"), F.count_if("matched").alias("matched_song_count"))
    return by.withColumn("matched_coverage_percent", F.expr("(matched_song_count * 100) div original_track_count").cast("int"))


def summary(marked: DataFrame) -> DataFrame:
    """One row: playlists by how much of them matched, and distinct tracks. Tracks whose key is '::' count
    for a playlist's length only."""
    real = F.col("song_id") != "::"
    lists = marked.groupBy("playlist_id").agg(F.count("*").alias("n"), F.count_if(real & F.col("matched")).alias("m"))
    totals = lists.agg(
        F.count("*").alias("total_playlists"),
        F.sum("n").alias("total_tracks"),
        F.sum("m").alias("matched_tracks"),
        F.count_if(F.expr("n = 0")).alias("empty_playlists"),
        F.count_if(F.expr("n > 0 and m = n")).alias("full_playlists"),
        F.count_if(F.expr("m = 0")).alias("zero_match_playlists"),
        F.count_if(F.expr("m > 0 and m < n")).alias("partial_playlists"),
    )
    distinct = marked.where(real).agg(
        F.count_distinct("song_id").alias("unique_tracks"),
        F.count_distinct(F.when(F.col("matched"), F.col("song_id"))).alias("unique_matched_tracks"),
        F.count_distinct(F.when(~F.col("matched"), F.col("song_id"))).alias("unique_missing_tracks"),
    )
    return totals.join(F.broadcast(distinct))  # one row each


def thresholds(marked: DataFrame) -> DataFrame:
    """Playlists that reach each step, by matched tracks and by share."""
    lists = marked.groupBy("playlist_id").agg(F.count("*").alias("n"), F.count_if(F.expr("matched and song_id != '::'")).alias("m"))
    columns = [F.count_if(F.col("m") >= s).alias(f"songs {s}") for s in MATCHED_STEPS]
    columns += [F.count_if((F.col("m") == F.col("n")) if s == 1.0 else (F.col("m") / F.col("n") >= s)).alias(f"share {s}") for s in COVERAGE_STEPS]
    one = lists.agg(*columns)
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("threshold"), F.col(f"`{c}`").alias("playlists")) for c in one.columns))).alias("x")).select("x.*")


def histogram(lists: DataFrame, column: str) -> DataFrame:
    """Playlists by bins of ten of a count, with a bar of at most 48 marks."""
    bins = lists.groupBy(length_bin(F.col(column)).alias("bin")).agg(F.count("*").alias("playlists"))
    most = bins.agg(F.max("playlists").alias("most"))
    bar = F.repeat(F.lit("#"), F.bround(F.col("playlists") * 48 / F.col("most")).cast("int"))
    return bins.join(F.broadcast(most)).select("bin", "playlists", bar.alias("bar"))


def filtered_rows(marked: DataFrame, which: str, whole: bool = False) -> DataFrame:
    """The matched tracks of the playlists that pass a filter; `whole`: also the names of playlist and album,
    empty where the tracks don't have them."""
    kept = per_playlist(marked).where(FILTERS[which])
    names = {"playlist_name": "name", "album_name": "album"} if whole else {}
    more = {k: (F.coalesce(F.col(c), F.lit("")) if c in marked.columns else F.lit("")).alias(k) for k, c in names.items()}
    rows = marked.where("matched").join(kept, "playlist_id")
    return rows.select(
        "playlist_id",
        *([more["playlist_name"]] if whole else []),
        "original_track_count",
        "matched_song_count",
        "matched_coverage_percent",
        "pos",
        F.col("title").alias("track_name"),
        F.col("artist").alias("artist_name"),
        *([more["album_name"]] if whole else []),
        "song_id",
    )


def filter_totals(marked: DataFrame) -> DataFrame:
    """Playlists and rows that each filter keeps, from one aggregate by playlist."""
    lists = per_playlist(marked)
    rows = [F.struct(F.lit(k).alias("filter"), F.expr(c).alias("kept")) for k, c in FILTERS.items()]
    each = lists.select("matched_song_count", F.explode(F.array(*rows)).alias("f"))
    return each.groupBy("f.filter").agg(F.count_if("f.kept").alias("playlists"), F.sum(F.when(F.col("f.kept"), F.col("matched_song_count")).otherwise(0)).alias("n_rows"))


def report(marked: DataFrame) -> DataFrame:
    """Lines of the summary as text: what, how many, and the share of its whole as a percentage."""
    one = summary(marked)
    total = {"full_playlists": "total_playlists", "partial_playlists": "total_playlists", "zero_match_playlists": "total_playlists", "matched_tracks": "total_tracks", "unique_matched_tracks": "unique_tracks", "unique_missing_tracks": "unique_tracks"}
    lines = [F.struct(F.lit(k).alias("line"), F.col(k).alias("n"), percent_text(F.col(k), F.col(t)).alias("share")) for k, t in total.items()]
    return one.select(F.explode(F.array(*lines)).alias("x")).select("x.*")
