"""Ordered collections into an observed part and a held-out end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def deduped(tracks: DataFrame) -> DataFrame:
    """The first place of each item of a collection."""
    return tracks.groupBy("playlist_id", "song_id").agg(F.min("pos").alias("pos"))


def numbered(rows: DataFrame) -> DataFrame:
    """Sorted rows with their place as case_idx, from 1: every task numbers its own, behind the counts of the
    tasks before it."""
    schema = T.StructType([*rows.schema.fields, T.StructField("case_idx", T.IntegerType(), False)])
    return rows.sparkSession.createDataFrame(rows.rdd.zipWithIndex().map(lambda x: (*x[0], x[1] + 1)), schema)


def holdout(tracks: DataFrame, holdout_k: int = 10, least: int = 20, cap: int | None = 1000) -> DataFrame:
    """case_idx, playlist_id, song_id, rn (place among the distinct items), n, observed.

    Collections with fewer than max(least, 2) distinct items go; of the others the first `cap` by id are
    cases, or all of them without a cap, numbered from 1 by id. The last min(holdout_k, n - 1) items are held
    out; with holdout_k = 0 there are no cases."""
    items = deduped(tracks)
    sizes = items.groupBy("playlist_id").agg(F.count("*").alias("n")).where(F.col("n") >= max(least, 2))
    if holdout_k <= 0:
        sizes = sizes.limit(0)
    chosen = sizes.orderBy("playlist_id")
    if cap:
        # at most `cap` rows are numbered
        chosen = F.broadcast(chosen.limit(cap).withColumn("case_idx", F.row_number().over(Window.orderBy("playlist_id"))))
    else:
        chosen = numbered(chosen)
    rank = F.row_number().over(Window.partitionBy("playlist_id").orderBy("pos"))
    held = F.least(F.lit(holdout_k), F.col("n") - 1)
    return items.join(chosen, "playlist_id").withColumn("rn", rank).select("case_idx", "playlist_id", "song_id", "rn", "n", (F.col("rn") <= F.col("n") - held).alias("observed"))


def lists(tracks: DataFrame, item: str, holdout_k: int = 10, least: int = 20) -> DataFrame:
    """playlist_id, songs (the distinct items in their order), n_seen: a row for each collection that holdout() takes."""
    first = tracks.groupBy("playlist_id", item).agg(F.min("pos").alias("pos"))
    rows = first.groupBy("playlist_id").agg(F.array_sort(F.collect_list(F.struct("pos", item))).alias("x")).where(F.size("x") >= max(least, 2))
    if holdout_k <= 0:
        rows = rows.limit(0)
    n = F.size("x")
    return rows.select("playlist_id", F.transform("x", lambda x: x[item]).alias("songs"), (n - F.least(F.lit(holdout_k), n - 1)).alias("n_seen"))


def of_lists(cases: DataFrame, numbers: DataFrame) -> DataFrame:
    """The rows of holdout() from numbered lists; `numbers` (song_id, sid) is short."""
    rows = cases.select("case_idx", "playlist_id", F.size("songs").cast("long").alias("n"), "n_seen", F.posexplode("songs").alias("p", "sid")).join(F.broadcast(numbers), "sid")
    return rows.select("case_idx", "playlist_id", "song_id", (F.col("p") + 1).alias("rn"), "n", (F.col("p") < F.col("n_seen")).alias("observed"))


def eval_ids(split: DataFrame) -> DataFrame:
    return split.groupBy(F.col("case_idx").alias("eval_index"), "playlist_id").agg(F.count_if("observed").alias("observed_count"), F.count_if(F.expr("not observed")).alias("heldout_count"))


def recent(split: DataFrame, window: int) -> DataFrame:
    """The last `window` observed items of each case; all of them if it is 0."""
    seen = split.where("observed")
    if window <= 0:
        return seen
    last = F.max("rn").over(Window.partitionBy("case_idx"))
    return seen.withColumn("_last", last).where(F.col("rn") > F.col("_last") - window).drop("_last")
