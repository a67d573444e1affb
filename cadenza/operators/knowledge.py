"""Knowledge texts of items and playlists, and dense vectors of them by TF-IDF and truncated SVD.

Coordinates of an SVD are defined up to sign and rotation; dot products aren't affected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.text import squeeze
from cadenza.operators.content import profile_bits
from cadenza.operators.split import recent


# The sentences of the texts.
ITEM = "item factual knowledge. title %s. artist %s. semantic tags %s. lyric evidence %s"
PLAYLIST = "preference reasoning knowledge. recent observed songs %s. frequent artists %s. long term semantic preferences %s. short term semantic intent %s."


def item_texts(songs: DataFrame, profiles: DataFrame, chars: int = 260) -> DataFrame:
    terms = profiles.select("song_id", F.array_join(profile_bits(first_value=False), " ").alias("terms"))
    text = F.format_string(
        ITEM, F.col("title"), F.col("artist"), F.coalesce("terms", F.lit("")), F.substring(squeeze(F.col("lyrics")), 1, chars)
    )
    return songs.join(terms, "song_id", "left").select("song_id", text.alias("text"))


def _most(rows: DataFrame, column: str, top: int, name: str) -> DataFrame:
    """The `top` most frequent values of each case as text (equal ones by name)."""
    counted = rows.groupBy("case_idx", column).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("case_idx").orderBy(F.desc("n"), column))
    best = counted.withColumn("rank", rank).where(F.col("rank") <= top).groupBy("case_idx")
    return best.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", column))), lambda x: x[column]), " ").alias(name))


def playlist_texts(split: DataFrame, songs: DataFrame, profiles: DataFrame, window: int = 12) -> DataFrame:
    """case_idx, text: recent songs, frequent artists, and the labels of all and of the recent songs."""
    seen = split.where("observed").join(songs.select("song_id", "title", "artist"), "song_id")
    late = recent(split, window).join(songs.select("song_id", "title", "artist"), "song_id")
    labels = profiles.select("song_id", F.explode(profile_bits(first_value=False)).alias("term"))
    names = late.groupBy("case_idx").agg(F.sort_array(F.collect_list(F.struct("rn", "title", "artist"))).alias("x"))
    names = names.select("case_idx", F.array_join(F.transform(F.slice("x", 1, 12), lambda s: F.concat(s["title"], F.lit(" by "), s["artist"])), "; ").alias("names"))
    parts = (
        names.join(_most(seen, "artist", 5, "artists"), "case_idx", "left")
        .join(_most(seen.join(labels, "song_id"), "term", 18, "terms"), "case_idx", "left")
        .join(_most(late.join(labels, "song_id"), "term", 12, "recent_terms"), "case_idx", "left")
    )
    text = F.format_string(
        PLAYLIST,
        *(F.coalesce(c, F.lit("")) for c in ("names", "artists", "terms", "recent_terms")),
    )
    return parts.select("case_idx", text.alias("text"))


#: Passes over the rows, columns beyond those asked for, matrices (features by columns) that reach the driver in
#: a pass, and rows that are multiplied at a time.
PASSES, OVERSAMPLE, SUMS, ROWS = 4, 10, 64, 512


def _gram_times(rows: DataFrame, base: np.ndarray) -> np.ndarray:
    """X'X times `base`, for sparse rows (at, value): summed up in each task, then in SUMS groups of tasks."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(base)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                ats, values = (batch.column(i).slice(lo, ROWS) for i in (0, 1))
                n = np.array([len(x) for x in ats])
                at, x = ats.flatten().to_numpy(), values.flatten().to_numpy()[:, None]
                who = np.repeat(np.arange(len(n)), n)
                product = np.zeros((len(n), base.shape[1]))
                np.add.at(product, who, x * base[at])
                np.add.at(total, at, x * product[who])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SUMS], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "total"])

    def add(parts: pa.Table) -> pa.Table:
        total = sum((np.frombuffer(x.as_py()) for x in parts["total"]), np.zeros(base.size))
        return pa.table({"total": pa.array([total.tobytes()], pa.binary())})

    sums = rows.mapInArrow(partial, "part int, total binary").groupBy("part").applyInArrow(add, "total binary")
    return sum((np.frombuffer(r.total).reshape(base.shape) for r in sums.collect()), np.zeros_like(base))


def svd(vectors: DataFrame, key: str, dimensions: int) -> tuple[DataFrame, list[float]]:
    """(key, vec) of unit length from long vectors (key, feature, value), and the singular values. The number
    of features is bounded by the encoder that made them; only they reach the driver."""
    spark = vectors.sparkSession
    features = [r.feature for r in vectors.select("feature").distinct().orderBy("feature").collect()]
    place = F.broadcast(spark.createDataFrame(list(enumerate(features)), "at int, feature string"))
    rows = vectors.join(place, "feature").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("x"))
    rows = rows.select(F.col("x.at").alias("at"), F.col("x.value").alias("value")).persist()
    size, kept = len(features), max(1, min(dimensions, len(features) - 1))
    # subspace iteration: every pass multiplies by X'X, summed up within each task
    base = np.linalg.qr(np.random.default_rng(0).normal(size=(size, min(size, kept + OVERSAMPLE))))[0]
    for _ in range(PASSES):
        base = np.linalg.qr(_gram_times(rows, base))[0]
    small, turn = np.linalg.eigh(base.T @ _gram_times(rows, base))
    rows.unpersist()
    order = np.argsort(-small)[:kept]
    v, values = base @ turn[:, order], np.sqrt(np.maximum(small[order], 0))
    table = F.broadcast(spark.createDataFrame([(f, [float(x) for x in v[i]]) for i, f in enumerate(features)], "feature string, weights array<double>"))
    long_ = vectors.join(table, "feature").select(key, "value", F.posexplode("weights").alias("c", "w")).groupBy(key, "c").agg(F.sum(F.col("value") * F.col("w")).alias("y"))
    dense = long_.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "y"))), lambda s: s["y"]).alias("vec"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    return dense.select(key, F.transform("vec", lambda x: x / F.greatest(norm, F.lit(1e-12))).alias("vec")), values.tolist()


def dot_scores(pool: DataFrame, users: DataFrame, items: DataFrame, name: str) -> DataFrame:
    """case_idx, song_id, `name`: the dot product of the two vectors, 0 where one is missing."""
    rows = pool.select("case_idx", "song_id").join(users.select("case_idx", F.col("vec").alias("u")), "case_idx", "left").join(items.select("song_id", F.col("vec").alias("i")), "song_id", "left")
    dot = F.aggregate(F.zip_with("u", "i", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return rows.select("case_idx", "song_id", F.coalesce(dot, F.lit(0.0)).alias(name))
