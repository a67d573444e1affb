"""Candidates and scores by semantic profiles: through the text of items, and through profiles of both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import vocabulary as v
from cadenza.functions.text import normalize_text
from cadenza.operators.cf import DIGITS
from cadenza.operators.profiles import strings


def vocabulary() -> tuple[list[str], list[str]]:
    """All words, and all phrases, that a profile's labels can ask a text for."""
    labels = dict.fromkeys([*(x for k in v.KEYS for x in v.ALLOWED[k]), *v.EXPANSIONS])
    terms = {w for ws in v.EXPANSIONS.values() for w in ws}
    for x in labels:
        phrase = x.replace("_", " ")
        terms |= {phrase, *(t for t in phrase.split() if len(t) >= 4)}
    return sorted(t for t in terms if " " not in t), sorted(t for t in terms if " " in t)


def text_scores(pool: DataFrame, terms: DataFrame, songs: DataFrame) -> DataFrame:
    """case_idx, song_id, score: 1 for each of the case's terms that is a word of the item's text, 2 for each
    phrase that is part of it. Every text is searched once, for the whole vocabulary, which is small."""
    words, phrases = vocabulary()
    text = normalize_text(F.concat_ws(" ", "title", "artist", "lyrics"))
    texts = songs.select("song_id", text.alias("text"))
    one = F.transform(F.array_intersect(F.split("text", " "), strings(words)), lambda t: F.struct(t.alias("term"), F.lit(1.0).alias("w")))
    two = F.transform(F.filter(strings(phrases), lambda p: F.contains(F.col("text"), p)), lambda t: F.struct(t.alias("term"), F.lit(2.0).alias("w")))
    held = texts.select("song_id", F.explode(F.concat(one, two)).alias("x")).select("song_id", "x.term", "x.w")
    keys = pool.select("case_idx", "song_id")
    found = keys.join(held, "song_id").join(terms, ["case_idx", "term"], "left_semi").groupBy("case_idx", "song_id").agg(F.sum("w").alias("score"))
    return keys.join(found, ["case_idx", "song_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def _features(labels: Column, key: str, weight: float) -> Column:
    return F.transform(labels, lambda x: F.struct(F.concat(F.lit(f"{key}:"), x).alias("feature"), F.lit(float(weight)).alias("w")))


def _asked(p: str) -> Column:
    """What a playlist's profile asks for: (feature, weight)."""
    col = lambda k: F.col(f"{p}.{k}")
    parts = [_features(col(k), k, w) for k, w in v.OVERLAP_WEIGHTS.items()]
    parts += [_features(F.filter(F.array(col(k)), lambda x: x != "mixed"), k, w) for k, w in v.EXACT_WEIGHTS.items()]
    parts.append(_features(F.array_intersect(col("top_keywords"), strings(list(v.CROSS))), "cross", 1.0))
    return F.explode(F.concat(*parts))


def _offered(s: str) -> Column:
    """The features that a song's profile offers, with a weight of no meaning."""
    col = lambda k: F.col(f"{s}.{k}")
    lists = [_features(col(k), k, 0) for k in v.OVERLAP_WEIGHTS] + [_features(F.array(col(k)), k, 0) for k in v.EXACT_WEIGHTS]
    values = F.array_union(col("affect"), col("narrative_theme"))
    cross = F.array_compact(F.array(*(F.when(F.arrays_overlap(values, strings(w)), F.lit(k)) for k, w in v.CROSS.items())))
    return F.explode(F.concat(*lists, _features(cross, "cross", 0)))


def profile_route(split: DataFrame, playlists: DataFrame, songs: DataFrame, pop: DataFrame, top: int = 500) -> DataFrame:
    """case_idx, song_id, semantic, rank: unobserved songs by their profile's likeness to the playlist's (above 0),
    then popularity, then id.

    Likeness is computed once for each pair of distinct profiles that share a feature, and of equal profiles only
    as many songs go on as a case can need: no case meets the catalog."""
    seen = split.where("observed").select("case_idx", "song_id")
    need = top + (seen.groupBy("case_idx").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0)
    name = lambda df, key: df.select(key, F.struct(*v.KEYS).alias("x")).select(key, "x", F.to_json("x").alias("class"))
    lists, items = name(playlists, "case_idx"), name(songs, "song_id")
    asked = lists.dropDuplicates(["class"]).select(F.col("class").alias("p_class"), _asked("x").alias("a")).select("p_class", "a.feature", "a.w")
    offered = items.dropDuplicates(["class"]).select(F.col("class").alias("s_class"), _offered("x").alias("o")).select("s_class", "o.feature")
    alike = asked.join(offered, "feature").groupBy("p_class", "s_class").agg(F.sum("w").alias("semantic"))
    popular = [F.coalesce("pop", F.lit(0)).desc(), F.col("song_id")]
    members = items.select("song_id", F.col("class").alias("s_class")).join(pop.select("song_id", "pop"), "song_id", "left")
    members = members.withColumn("place", F.row_number().over(Window.partitionBy("s_class").orderBy(*popular))).where(F.col("place") <= need)
    order = [F.round("semantic", DIGITS).desc(), *popular]
    best = alike.join(members, "s_class").withColumn("at", F.row_number().over(Window.partitionBy("p_class").orderBy(*order))).where(F.col("at") <= need)
    rows = lists.select("case_idx", F.col("class").alias("p_class")).join(best, "p_class").join(seen, ["case_idx", "song_id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("case_idx").orderBy("at"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top).select("case_idx", "song_id", "semantic", "rank")


def text_route(split: DataFrame, terms: DataFrame, index: DataFrame, pop: DataFrame, top: int = 500) -> DataFrame:
    """case_idx, song_id, score, rank: what `direct_scores` finds for each case, the best `top`, by popularity and id
    where scores are equal. Scores are made for each distinct set of terms, of which there are few, and only as
    many songs of a set go on as a case can need."""
    seen = split.where("observed").select("case_idx", "song_id")
    need = top + (seen.groupBy("case_idx").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0)
    sets = terms.groupBy("case_idx").agg(F.array_sort(F.collect_set("term")).alias("terms")).withColumn("class", F.to_json("terms"))
    words = F.filter(F.split(normalize_text(F.col("term")), " "), lambda t: F.length(t) >= 3)
    parts = sets.dropDuplicates(["class"]).select("class", F.explode("terms").alias("term")).select("class", words.alias("w")).where("size(w) > 0")
    parts = parts.select("class", F.explode("w").alias("token"), (F.when(F.size("w") > 1, 2.0).otherwise(1.0) / F.size("w")).alias("weight"))
    found = parts.groupBy("class", "token").agg(F.sum("weight").alias("weight")).join(index, "token").groupBy("class", "song_id").agg(F.sum("weight").alias("score"))
    order = Window.partitionBy("class").orderBy(F.round("score", DIGITS).desc(), F.coalesce("pop", F.lit(0)).desc(), "song_id")
    best = found.join(pop.select("song_id", "pop"), "song_id", "left").withColumn("at", F.row_number().over(order)).where(F.col("at") <= need)
    rows = sets.select("case_idx", "class").join(best, "class").join(seen, ["case_idx", "song_id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("case_idx").orderBy("at"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top).select("case_idx", "song_id", "score", "rank")
