"""Writers: marked playlists, filtered rows, caches, evaluation ids."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.coverage import FILTERS, filtered_rows, per_playlist
from cadenza.operators.split import eval_ids
from cadenza.sources.readers import _file_system, exists


def marking_totals(marked: DataFrame, done: DataFrame | None = None, dry_run: bool = False) -> DataFrame:
    """One row: slices (files), playlists, tracks, matched, and how many slices were skipped and written. marked
    has a column `slice`; `done` the slices that stay as they are."""
    by = marked.groupBy("slice").agg(F.count_distinct("playlist_id").alias("playlists"), F.count("*").alias("tracks"), F.count_if("matched").alias("matched"))
    by = by.withColumn("skipped", F.lit(0)) if done is None else by.join(done.withColumn("skipped", F.lit(1)), "slice", "left")
    by = by.withColumn("skipped", F.coalesce("skipped", F.lit(0)))
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("playlists", "tracks", "matched", "skipped")]
    written = F.lit(0).cast("long") if dry_run else F.col("files") - F.col("skipped")
    return by.agg(F.count("*").alias("files"), *sums).withColumn("written", written)


def write_marked(marked: DataFrame, path: str, force: bool = False, dry_run: bool = False) -> DataFrame:
    """JSON records of playlists with their tracks and how much of them matched, a folder for each `slice` (one,
    where `marked` has no such column). Slices that have been written stay unless `force`; the committer makes a
    write all or nothing; `dry_run` writes nothing. Returns the totals of the run."""
    spark = marked.sparkSession
    rows = marked if "slice" in marked.columns else marked.withColumn("slice", F.lit(0))
    done = None
    if not force and exists(spark, path):
        names = spark.createDataFrame([(n,) for n in slices_of(spark, path)], "name string")
        done = rows.select("slice").distinct().join(names, F.col("slice").cast("string") == F.col("name"), "left_semi")
    totals = spark.createDataFrame(marking_totals(rows, done, dry_run).collect(), "files long, playlists long, tracks long, matched long, skipped long, written long")
    if not dry_run:
        fresh = rows if done is None else rows.join(done, "slice", "left_anti")
        tracks = fresh.groupBy("slice", "playlist_id").agg(F.sort_array(F.collect_list(F.struct("pos", "title", "artist", "song_id"))).alias("tracks"))
        stats = per_playlist(fresh).select("playlist_id", "matched_song_count", "matched_coverage_percent")
        out = tracks.join(stats, "playlist_id").write.partitionBy("slice")
        out = out.mode("overwrite").option("partitionOverwriteMode", "dynamic") if force else out.mode("append")
        out.json(path)
    return totals


def slices_of(spark, path: str) -> list[str]:
    """The slices that a folder has been written for."""
    hadoop, fs = _file_system(spark, path)
    return [s.getPath().getName().split("=", 1)[1] for s in fs.listStatus(hadoop) if "=" in s.getPath().getName()]


def write_filtered(marked: DataFrame, path: str) -> None:
    """The rows of each filter as CSV with all ten columns, from one reading of the playlists."""
    kept = marked.persist()
    try:
        for which in FILTERS:
            filtered_rows(kept, which, whole=True).write.mode("overwrite").option("header", True).csv(f"{path}/{which}")
    finally:
        kept.unpersist()


def append_cache(profiles: DataFrame, path: str) -> None:
    """Records (cache_key and the nine keys) to a cache of JSON lines, with the time as `seq`: later ones win."""
    semantic = F.struct(*sorted(c for c in profiles.columns if c != "cache_key")).alias("semantic")
    profiles.select("cache_key", semantic, F.lit(time.time_ns() // 1000).alias("seq")).write.mode("append").json(path)


def write_diversity(stats: DataFrame, rows: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").option("header", True).csv(f"{path}/summary")
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/rows")


def write_eval_ids(split: DataFrame, path: str) -> None:
    eval_ids(split).orderBy("eval_index").write.mode("overwrite").option("header", True).csv(path)
