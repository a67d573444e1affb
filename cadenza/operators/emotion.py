"""Emotion vectors from profiles, taste vectors of playlists, and their fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import vocabulary as v
from cadenza.operators.split import recent


def unit(vectors: DataFrame, key: str) -> DataFrame:
    """Long vectors (key, feature, value) to length 1; those of length 0 have no rows."""
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(key)))
    return vectors.withColumn("_n", norm).where("_n > 0").select(key, "feature", (F.col("value") / F.col("_n")).alias("value"))


def song_vectors(profiles: DataFrame) -> DataFrame:
    """song_id, feature, value: the labels but `mixed`, by the weight of their key."""
    def of(key: str, weight: float) -> Column:
        labels = F.array_distinct(F.col(key) if key in v.LIST_KEYS else F.array(F.col(key)))
        return F.transform(
            F.filter(labels, lambda x: (x != "mixed") & (x != "")),
            lambda x: F.struct(F.concat(F.lit(f"{key}:"), x).alias("feature"), F.lit(weight).alias("value")),
        )

    entries = F.concat(*(of(k, w) for k, w in v.VECTOR_WEIGHTS.items()))
    return unit(profiles.select("song_id", F.explode(entries).alias("e")).select("song_id", "e.feature", "e.value"), "song_id")


def _mean(items: DataFrame, vectors: DataFrame) -> DataFrame:
    return unit(items.select("case_idx", "song_id").join(vectors, "song_id").groupBy("case_idx", "feature").agg(F.sum("value").alias("value")), "case_idx")


def user_vectors(split: DataFrame, vectors: DataFrame, window: int = 8) -> tuple[DataFrame, DataFrame]:
    """(case_idx, feature, value) of each case, and (case_idx, alpha): long and short taste are blended by
    how far they are apart."""
    long_ = _mean(split.where("observed"), vectors).withColumnRenamed("value", "l")
    short = _mean(recent(split, window), vectors).withColumnRenamed("value", "s")
    both = long_.join(short, ["case_idx", "feature"], "full").select("case_idx", "feature", F.coalesce("l", F.lit(0.0)).alias("l"), F.coalesce("s", F.lit(0.0)).alias("s"))
    cosine = F.sum(F.col("l") * F.col("s")).over(Window.partitionBy("case_idx"))
    alpha = F.greatest(F.lit(0.25), F.least(F.lit(0.75), 0.35 + 0.35 * (1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("cos"))))))
    mixed = both.withColumn("cos", cosine).withColumn("alpha", alpha)
    users = unit(mixed.select("case_idx", "feature", ((1 - F.col("alpha")) * F.col("l") + F.col("alpha") * F.col("s")).alias("value")), "case_idx")
    return users, mixed.groupBy("case_idx").agg(F.max("alpha").alias("alpha"))


def emotion_scores(pool: DataFrame, users: DataFrame, vectors: DataFrame) -> DataFrame:
    """case_idx, song_id, lemon: the cosine of the case's and the candidate's vector; 0 without either."""
    u = users.select("case_idx", "feature", F.col("value").alias("u"))
    # a candidate meets its few features, not every song
    dots = pool.select("case_idx", "song_id").join(vectors, "song_id").join(u, ["case_idx", "feature"]).groupBy("case_idx", "song_id").agg(F.sum(F.col("value") * F.col("u")).alias("lemon"))
    return pool.select("case_idx", "song_id").join(dots, ["case_idx", "song_id"], "left").withColumn("lemon", F.coalesce("lemon", F.lit(0.0)))
