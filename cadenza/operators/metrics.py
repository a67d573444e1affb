"""Recall@K, NDCG@K and their mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_hits(ranked: DataFrame, split: DataFrame) -> DataFrame:
    truth = split.where("not observed").select("case_idx", "song_id", F.lit(1).alias("hit"))
    return ranked.join(truth, ["case_idx", "song_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def evaluate(ranked: DataFrame, split: DataFrame, k: int = 10, keys: tuple[str, ...] = ("variant",)) -> DataFrame:
    """Means over all cases, by `keys`: recall, ndcg (binary gains over the best that the held-out items
    allow), proxy. `ranked` has case_idx, song_id, rank."""
    sizes = split.groupBy("case_idx").agg(F.count_if(F.expr("not observed")).alias("n_true"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_true", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    sizes = sizes.where("n_true > 0").withColumn("ideal", ideal)
    n = split.agg(F.count_distinct("case_idx").alias("n_cases"))
    hits = with_hits(ranked.where(F.col("rank") <= k), split)
    by_case = hits.groupBy(*keys, "case_idx").agg(F.sum("hit").alias("hits"), F.sum(F.when(F.col("hit") == 1, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("gain"))
    total = by_case.join(sizes, "case_idx").groupBy(*keys).agg(F.sum(F.col("hits") / F.col("n_true")).alias("r"), F.sum(F.col("gain") / F.col("ideal")).alias("g"))
    recall, ndcg = F.col("r") / F.col("n_cases"), F.col("g") / F.col("n_cases")
    return total.join(F.broadcast(n)).select(*keys, F.round(recall, 6).alias("recall"), F.round(ndcg, 6).alias("ndcg"), F.round((recall + ndcg) / 2, 6).alias("proxy"))


def best(metrics: DataFrame, order: dict[str, int]) -> DataFrame:
    """The variant with the highest proxy; of equal ones the earliest."""
    place = F.create_map(*(x for v, i in order.items() for x in (F.lit(v), F.lit(i))))
    return metrics.withColumn("at", place[F.col("variant")]).orderBy(F.desc("proxy"), "at").limit(1).drop("at")
