"""Scores of candidates, their normalisation, fusion and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.cf import DIGITS

# The weights of the fusion.
WEIGHTS = {"cf": 0.35, "artist": 0.10, "pop": 0.10}


def min_max(score: Column, by: str = "case_idx") -> Column:
    """To 0..1 over the candidates of a case; if all are equal, 1 where the score is positive."""
    w = Window.partitionBy(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high <= low, (score > 0).cast("double")).otherwise((score - low) / F.nullif(high - low, F.lit(0.0)))


def prepare(split: DataFrame, songs: DataFrame, pool: DataFrame, cf: DataFrame, pop: DataFrame) -> DataFrame:
    """case_idx, song_id, and cf, artist, pop: raw and normalised over the pool."""
    art = songs.select("song_id", "artist")
    counts = split.where("observed").join(art, "song_id").groupBy("case_idx", "artist").agg(F.count("*").alias("n"))
    rows = (
        pool.select("case_idx", "song_id")
        .join(cf.select("case_idx", "song_id", "cf"), ["case_idx", "song_id"], "left")
        .join(art, "song_id", "left")
        .join(counts, ["case_idx", "artist"], "left")
        .join(pop.select("song_id", "pop"), "song_id", "left")
        .select("case_idx", "song_id", F.coalesce("cf", F.lit(0.0)).alias("cf"), F.coalesce(F.col("n").cast("double"), F.lit(0.0)).alias("artist"), F.coalesce(F.col("pop").cast("double"), F.lit(0.0)).alias("pop"))
    )
    return rows.select("*", *(min_max(F.col(c)).alias(f"{c}_norm") for c in ("cf", "artist", "pop")))


def cold_start(split: DataFrame, cf: DataFrame, threshold: int = 1) -> DataFrame:
    """Cases with few observed items or without any score."""
    sizes = split.groupBy("case_idx").agg(F.count_if("observed").alias("n_observed"))
    scored = cf.groupBy("case_idx").agg(F.count("*").alias("n_scored"))
    rows = sizes.join(scored, "case_idx", "left").withColumn("n_scored", F.coalesce("n_scored", F.lit(0)))
    return rows.withColumn("cold_start", (F.col("n_observed") <= threshold) | (F.col("n_scored") == 0))


def rank_variants(prepared: DataFrame, variants: dict[str, dict[str, float]], top: int = 10) -> DataFrame:
    """variant, case_idx, song_id, score, rank of the `top` of each case, for several weightings in one pass."""
    names = sorted({k for w in variants.values() for k in w})
    table = F.array(*(F.struct(F.lit(v).alias("variant"), *(F.lit(float(w.get(n, 0.0))).alias(n) for n in names)) for v, w in variants.items()))
    rows = prepared.withColumn("v", F.explode(table))
    score = sum((F.col(f"v.{n}") * F.col(f"{n}_norm") for n in names[1:]), F.col(f"v.{names[0]}") * F.col(f"{names[0]}_norm"))
    rows = rows.select("v.variant", "case_idx", "song_id", score.alias("score"))
    rank = F.row_number().over(Window.partitionBy("variant", "case_idx").orderBy(F.round("score", DIGITS).desc(), "song_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top)
