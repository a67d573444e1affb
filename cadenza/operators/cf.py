"""Item-item collaborative filtering on observed items.

Scores are compared after rounding to nine places, so that the order of a sum can't change a ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 9


def popularity(split: DataFrame) -> DataFrame:
    """song_id, pop (cases that observed it), and its first appearance."""
    return split.where("observed").groupBy("song_id").agg(F.count("*").alias("pop"), F.min(F.struct("case_idx", "rn")).alias("first"))


def popular(pop: DataFrame, top: int = 500) -> DataFrame:
    """The most popular items, equal ones by first appearance: song_id, pop, pop_rank."""
    best = pop.orderBy(F.desc("pop"), "first").limit(top)
    return best.withColumn("pop_rank", F.row_number().over(Window.orderBy(F.desc("pop"), "first"))).select("song_id", "pop", "pop_rank")


def cooccurrence(split: DataFrame) -> DataFrame:
    """src, dst, n: cases that observed both, in either direction. Pairs are made within a case, in one direction,
    and are summed up before they are shuffled; only the sums are mirrored. A case gives pairs in proportion to the
    square of its length."""
    seen = split.where("observed").select("case_idx", "song_id")
    pairs = seen.select("case_idx", F.col("song_id").alias("src")).join(seen.select("case_idx", F.col("song_id").alias("dst")), "case_idx")
    once = pairs.where("src < dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    both = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return once.select(F.explode(both).alias("p"), "n").select("p.src", "p.dst", "n")


def neighbors(split: DataFrame, top: int = 100) -> DataFrame:
    """src, dst, weight (co-occurrence over the root of both popularities), nb_rank up to `top`."""
    return weighted_neighbors(cooccurrence(split), popularity(split), top)


def weighted_neighbors(counts: DataFrame, pop: DataFrame, top: int = 100) -> DataFrame:
    """The same from counts (src, dst, n) and popularities (song_id, pop)."""
    a = pop.select(F.col("song_id").alias("src"), F.col("pop").alias("a"))
    b = pop.select(F.col("song_id").alias("dst"), F.col("pop").alias("b"))
    weighted = counts.join(a, "src").join(b, "dst").select("src", "dst", (F.col("n") / F.sqrt(F.col("a") * F.col("b"))).alias("weight"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.round("weight", DIGITS).desc(), "dst"))
    return weighted.withColumn("nb_rank", rank).where(F.col("nb_rank") <= top)


def cf_scores(split: DataFrame, near: DataFrame, top: int = 500) -> DataFrame:
    """case_idx, song_id, cf, touch_rank: the `top` unobserved items by the summed weights of the observed
    items' neighbours; equal ones by the first that was reached."""
    seen = split.where("observed").select("case_idx", F.col("song_id").alias("src"), "rn")
    hits = seen.join(near, "src").groupBy("case_idx", F.col("dst").alias("song_id")).agg(F.sum("weight").alias("cf"), F.min(F.struct("rn", "nb_rank")).alias("touch"))
    new = hits.join(seen.select("case_idx", F.col("src").alias("song_id")), ["case_idx", "song_id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("case_idx").orderBy(F.round("cf", DIGITS).desc(), "touch"))
    return new.withColumn("touch_rank", rank).where(F.col("touch_rank") <= top).select("case_idx", "song_id", "cf", "touch_rank")
