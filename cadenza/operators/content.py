"""Content route: TF-IDF of words and word pairs, and similarity to what a case observed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import vocabulary as v
from cadenza.functions.text import excerpt
from cadenza.operators.cf import DIGITS
from cadenza.operators.emotion import unit
from cadenza.operators.split import recent


def terms_of(text: Column) -> Column:
    """Words that begin with a letter, in lower case, and pairs of neighbours."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), lambda w: w.rlike("^[a-z][a-z0-9_]+$"))
    return F.concat(words, F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b)))


def profile_bits(first_value: bool = True) -> Column:
    """A profile's labels as text, each alone and after its key (or the other way round)."""
    def of(key: str) -> Column:
        labels = F.transform(F.col(key) if key in v.LIST_KEYS else F.array(F.col(key)), lambda x: F.trim(F.replace(x, F.lit("_"), F.lit(" "))))
        named = lambda x: F.concat(F.lit(f"{key} "), x)
        pair = (lambda x: F.array(x, named(x))) if first_value else (lambda x: F.array(named(x), x))
        return F.flatten(F.transform(F.filter(labels, lambda x: (x != "") & (x != "mixed")), pair))

    return F.concat(*map(of, v.KEYS))


def content_text(songs: DataFrame, profiles: DataFrame | None = None, chars: int = 500) -> DataFrame:
    """song_id, text: title, artist, the start of the lyrics and the profile's labels."""
    rows = songs.select("song_id", "title", "artist", excerpt(F.col("lyrics"), chars).alias("lyrics"))
    if profiles is None:
        return rows.select("song_id", F.concat_ws(" ", "title", "artist", "lyrics", F.lit("")).alias("text"))
    bits = profiles.select("song_id", F.array_join(profile_bits(), " ").alias("bits"))
    return rows.join(bits, "song_id", "left").select("song_id", F.concat_ws(" ", "title", "artist", "lyrics", F.coalesce("bits", F.lit(""))).alias("text"))


def tfidf(texts: DataFrame, key: str = "song_id", features: int = 6000) -> DataFrame:
    """key, feature, value: unit vectors over the `features` most frequent terms (equal ones by name), with
    the weight tf * (ln((1 + n) / (1 + df)) + 1)."""
    counts = texts.select(key, F.explode(terms_of(F.col("text"))).alias("feature")).groupBy(key, "feature").agg(F.count("*").alias("tf"))
    stats = counts.groupBy("feature").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
    kept = stats.orderBy(F.desc("total"), "feature").limit(features).select("feature", "df")
    n = texts.agg(F.count("*").alias("n"))
    weighted = counts.join(F.broadcast(kept), "feature").join(F.broadcast(n))  # at most `features` rows, and one
    return unit(weighted.select(key, "feature", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("value")), key)


#: Cases and songs that meet in one product of matrices.
CASES, SONGS = 512, 1024


def _best(width: int, top: int):
    """The best songs of a block for the cases of a block: one matrix product."""

    def dense(ats: pa.ChunkedArray, values: pa.ChunkedArray) -> np.ndarray:
        ats, values = ats.combine_chunks(), values.combine_chunks()
        out = np.zeros((len(ats), width))
        rows = np.repeat(np.arange(len(ats)), np.diff(ats.offsets.to_numpy()))
        out[rows, ats.flatten().to_numpy()] = values.flatten().to_numpy()
        return out

    def run(cases: pa.Table, songs: pa.Table) -> pa.Table:
        case, song, score = [], [], []
        if cases.num_rows and songs.num_rows:
            songs = songs.sort_by("song_id")  # of equal scores the first id counts
            names = np.array(songs["song_id"].to_pylist(), object)
            place = {n: i for i, n in enumerate(names)}
            product = dense(cases["at"], cases["value"]) @ dense(songs["at"], songs["value"]).T
            for who, total, seen, row in zip(cases["case_idx"].to_pylist(), cases["total"].to_pylist(), cases["seen"].to_pylist(), product, strict=True):
                row = row / total
                row[[place[s] for s in seen if s in place]] = 0
                found = np.argsort(-np.round(row, DIGITS), kind="stable")[:top]
                found = found[row[found] > 0]
                case.append(np.full(len(found), who))
                song.append(names[found])
                score.append(row[found])
        join = lambda x: np.concatenate(x) if x else np.empty(0)
        return pa.table({"case_idx": pa.array(join(case), pa.int32()), "song_id": pa.array(join(song), pa.string()), "content": pa.array(join(score), pa.float64())})

    return run


def content_scores(split: DataFrame, vectors: DataFrame, window: int = 10, top: int = 500) -> DataFrame:
    """case_idx, song_id, content, content_rank: unobserved items by similarity to the weighted mean of the
    observed ones (the last `window` twice).

    Blocks of cases meet blocks of songs in matrix products, of which only each case's best `top` come out; so no
    row is made for a pair of case and song. The number of features is bounded by the encoder that made them."""
    late = recent(split, window).select("case_idx", "song_id", F.lit(2.0).alias("w"))
    seen = split.where("observed").select("case_idx", "song_id")
    weights = seen.join(late, ["case_idx", "song_id"], "left").withColumn("w", F.coalesce("w", F.lit(1.0)))
    have = weights.join(vectors.select("song_id").distinct(), "song_id", "left_semi")
    total = have.groupBy("case_idx").agg(F.sum("w").alias("total"))
    features = [r.feature for r in vectors.select("feature").distinct().orderBy("feature").collect()]
    place = F.broadcast(split.sparkSession.createDataFrame(list(enumerate(features)), "at int, feature string"))  # one row for each feature
    placed = vectors.join(place, "feature").select("song_id", "at", "value")
    row = lambda df, key: df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("x")).select(key, F.col("x.at").alias("at"), F.col("x.value").alias("value"))
    profile = have.join(placed, "song_id").groupBy("case_idx", "at").agg(F.sum(F.col("w") * F.col("value")).alias("value"))
    cases = row(profile, "case_idx").join(total, "case_idx").join(seen.groupBy("case_idx").agg(F.collect_set("song_id").alias("seen")), "case_idx")
    songs = row(placed, "song_id")
    case_blocks, song_blocks = -(-split.select("case_idx").distinct().count() // CASES), -(-vectors.select("song_id").distinct().count() // SONGS)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
    cases = cases.withColumn("c", F.pmod(F.xxhash64("case_idx"), F.lit(max(case_blocks, 1))).cast("int")).withColumn("s", every(song_blocks))
    songs = songs.withColumn("s", F.pmod(F.xxhash64("song_id"), F.lit(max(song_blocks, 1))).cast("int")).withColumn("c", every(case_blocks))
    best = cases.groupBy("c", "s").cogroup(songs.groupBy("c", "s")).applyInArrow(_best(max(len(features), 1), top), "case_idx int, song_id string, content double")
    rank = F.row_number().over(Window.partitionBy("case_idx").orderBy(F.round("content", DIGITS).desc(), "song_id"))
    return best.withColumn("content_rank", rank).where(F.col("content_rank") <= top)
