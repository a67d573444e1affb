"""Semantic profiles: nine keys over a controlled vocabulary, from words of the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import vocabulary as v
from cadenza.functions.text import normalize_text


def strings(values) -> Column:
    return F.array(*map(F.lit, values))


def hits(tokens: Column, words: list[str]) -> Column:
    """How many different words of a list stand in the text."""
    return F.size(F.array_intersect(tokens, strings(words)))


def normalize_label(label: Column, key: str) -> Column:
    """The label in its normal form, through the aliases; '' where the key doesn't allow it."""
    plain = F.replace(normalize_text(label), F.lit(" "), F.lit("_"))
    alias = F.create_map(*(x for a, b in v.ALIASES.items() for x in (F.lit(a), F.lit(b))))
    known = F.coalesce(F.try_element_at(alias, plain), plain)
    return F.when(known.isin(v.ALLOWED[key]), known).otherwise("")


def fallback(key: str) -> str:
    if key in v.FALLBACKS:
        return v.FALLBACKS[key]
    return "mixed" if "mixed" in v.ALLOWED[key] else v.ALLOWED[key][0]


def normalize_list(labels: Column, key: str) -> Column:
    """Allowed labels, each once, at most three; keywords are filled up to three."""
    clean = F.array_distinct(F.filter(F.transform(F.coalesce(labels, strings([])), lambda x: normalize_label(x, key)), lambda x: x != ""))
    if key == "top_keywords":
        return F.slice(F.array_distinct(F.concat(clean, strings(v.FALLBACK_KEYWORDS))), 1, 3)
    return F.when(F.size(clean) == 0, strings([fallback(key)])).otherwise(F.slice(clean, 1, 3))


def normalize_scalar(label: Column, key: str) -> Column:
    return F.coalesce(F.nullif(normalize_label(label, key), F.lit("")), F.lit(fallback(key)))


def normalize_profile(profile: dict[str, Column]) -> list[Column]:
    """The nine keys of any profile; what it lacks falls back."""
    out = []
    for k in v.KEYS:
        c = profile.get(k)
        if k in v.LIST_KEYS:
            out.append((normalize_list(c, k) if c is not None else F.when(F.lit(True), normalize_list(strings([]), k))).alias(k))
        else:
            out.append((normalize_scalar(c, k) if c is not None else F.lit(fallback(k))).alias(k))
    return out


def top_labels(tokens: Column, words: dict[str, list[str]], key: str, pad: list[str], limit: int = 3) -> Column:
    """Labels by falling hits, then by name; without hits they don't count; filled up from `pad`."""
    scored = F.array(*(F.struct((-hits(tokens, w)).alias("minus"), F.lit(label).alias("label")) for label, w in words.items() if label in v.ALLOWED[key]))
    best = F.transform(F.slice(F.sort_array(F.filter(scored, lambda s: s["minus"] < 0)), 1, limit), lambda s: s["label"])
    return F.slice(F.array_distinct(F.concat(best, strings(pad))), 1, limit)


def more_of(a: Column, b: Column, if_a: str, if_b: str, else_: str) -> Column:
    return F.when(a > b, if_a).when(b > a, if_b).otherwise(else_)


def song_profiles(songs: DataFrame) -> DataFrame:
    """song_id and the nine keys, from the words of title and lyrics."""
    tokens = F.col("tokens")
    rows = songs.select("song_id", F.array_distinct(F.split(normalize_text(F.concat_ws(" ", "title", "lyrics")), " ")).alias("tokens"))
    context = F.array_max(F.array(*(F.struct(hits(tokens, w).alias("n"), F.lit(label).alias("label")) for label, w in v.CONTEXT_WORDS.items())))
    profile = {
        "top_keywords": top_labels(tokens, v.EXPANSIONS, "top_keywords", v.FALLBACK_KEYWORDS),
        "affect": top_labels(tokens, v.AFFECT_WORDS, "affect", ["mixed"]),
        "energy": more_of(hits(tokens, v.EXPANSIONS["high_arousal"]), hits(tokens, v.EXPANSIONS["low_arousal"]), "high", "low", "mid"),
        "valence": more_of(hits(tokens, v.SONG_POSITIVE), hits(tokens, v.SONG_NEGATIVE), "positive", "negative", "mixed"),
        "genre_style": top_labels(tokens, v.GENRE_WORDS, "genre_style", ["mixed"]),
        "narrative_theme": top_labels(tokens, v.THEME_WORDS, "narrative_theme", ["mixed"]),
        "listening_context": F.when(context["n"] > 0, context["label"]).otherwise("mixed"),
        "cohesion": F.lit("mixed"),
        "next_song_role": F.lit("same_vibe"),
    }
    return rows.select("song_id", *(c.alias(k) for k, c in profile.items())).select("song_id", *normalize_profile({k: F.col(k) for k in profile}))


def counted(songs: DataFrame) -> DataFrame:
    """song_id, artist in lower case, and how often words of each kind occur in the song's text."""
    text = F.lower(F.concat_ws(" ", "title", "artist", "lyrics"))
    words = F.regexp_extract_all(text, F.lit("([a-zA-Z][a-zA-Z']{2,})"), F.lit(1))
    in_ = lambda name: F.size(F.filter(F.col("words"), lambda x: x.isin(name)))
    return songs.select("song_id", F.lower("artist").alias("artist"), words.alias("words")).select(
        "song_id",
        "artist",
        *(in_(w).alias(n) for n, w in (("pos", v.LIST_POSITIVE), ("neg", v.LIST_NEGATIVE), ("high", v.LIST_HIGH), ("low", v.LIST_LOW), ("club", ["party", "dance", "club"]))),
    )


def playlist_profiles(split: DataFrame, songs: DataFrame) -> DataFrame:
    """case_idx and the nine keys, from how often words occur in the observed items."""
    seen = split.where("observed").join(counted(songs), "song_id")
    by_artist = seen.groupBy("case_idx", "artist").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("pos", "neg", "high", "low", "club")))
    by = by_artist.groupBy("case_idx").agg((F.max("n") / F.sum("n")).alias("share"), *(F.sum(c).alias(c) for c in ("pos", "neg", "high", "low", "club")))
    return profiles_of_counts(by, "case_idx")


def profiles_of_counts(by: DataFrame, key: str) -> DataFrame:
    """`key` and the nine keys, from the share of the most frequent artist and the counts of words."""
    pos, neg, high, low = (F.col(c) for c in ("pos", "neg", "high", "low"))
    keywords = F.when(high > low, strings(["dancefloor", "high_arousal", "party"])).when(low > high, strings(["melancholic_story", "low_arousal", "chill"])).otherwise(strings(["mixed", "nostalgic", "singalong"]))
    profile = {
        "top_keywords": keywords,
        "affect": F.array(more_of(pos, neg, "euphoric", "melancholic", "mixed")),
        "energy": more_of(high, low, "high", "low", "mid"),
        "valence": more_of(pos, neg, "positive", "negative", "mixed"),
        "genre_style": strings(["mixed"]),
        "narrative_theme": F.array(more_of(pos, neg, "celebration", "heartbreak", "mixed")),
        "listening_context": F.when(F.col("club") > 0, "party").otherwise("mixed"),
        "cohesion": F.when(F.col("share") >= 0.5, "genre").otherwise("mixed"),
        "next_song_role": F.lit("same_vibe"),
    }
    return by.select(key, *(c.alias(k) for k, c in profile.items())).select(key, *normalize_profile({k: F.col(k) for k in profile}))


def similarity(a: str, b: str) -> Column:
    """How well a song's profile (columns under `b`) fits a playlist's (under `a`)."""
    p, s = (lambda k: F.col(f"{a}.{k}")), (lambda k: F.col(f"{b}.{k}"))
    score = F.lit(0.0)
    for k, w in v.OVERLAP_WEIGHTS.items():
        score = score + w * F.size(F.array_intersect(p(k), s(k)))
    for k, w in v.EXACT_WEIGHTS.items():
        score = score + F.when((p(k) != "mixed") & (p(k) == s(k)), F.lit(w)).otherwise(0.0)
    values = F.array_union(s("affect"), s("narrative_theme"))
    for k, other in v.CROSS.items():
        score = score + F.when(F.array_contains(p("top_keywords"), k) & F.arrays_overlap(values, strings(other)), 1.0).otherwise(0.0)
    return score


def profile_scores(pool: DataFrame, playlists: DataFrame, songs: DataFrame) -> DataFrame:
    """case_idx, song_id, semantic for the candidates; 0 where a profile is missing."""
    p = playlists.select("case_idx", F.struct(*v.KEYS).alias("p"))
    s = songs.select("song_id", F.struct(*v.KEYS).alias("s"))
    rows = pool.select("case_idx", "song_id").join(p, "case_idx", "left").join(s, "song_id", "left")
    return rows.select("case_idx", "song_id", F.coalesce(similarity("p", "s"), F.lit(0.0)).alias("semantic"))


def semantic_terms(playlists: DataFrame) -> DataFrame:
    """case_idx, term: the profile's labels as phrases, their words, and what the labels expand to."""
    lists = [F.col(k) if k in v.LIST_KEYS else F.array(F.col(k)) for k in v.KEYS]
    labels = playlists.select("case_idx", F.explode(F.array_distinct(F.concat(*lists))).alias("label"))
    expand = F.create_map(*(x for k, w in v.EXPANSIONS.items() for x in (F.lit(k), strings(w))))
    phrase = F.trim(F.regexp_replace(F.col("label"), "[^a-z0-9]+", " "))
    long_ = F.filter(F.split(phrase, " "), lambda t: F.length(t) >= 4)
    terms = F.concat(F.coalesce(F.try_element_at(expand, F.col("label")), F.array().cast("array<string>")), F.when(F.length(phrase) >= 3, F.array(phrase)).otherwise(F.array().cast("array<string>")), long_)
    return labels.select("case_idx", F.explode(terms).alias("term")).distinct()


def token_index(songs: DataFrame) -> DataFrame:
    """token, song_id: words of at least three letters or digits in title, artist and lyrics."""
    text = normalize_text(F.concat_ws(" ", "title", "artist", "lyrics"))
    return songs.select("song_id", F.explode(F.array_distinct(F.filter(F.split(text, " "), lambda t: F.length(t) >= 3))).alias("token"))


def direct_scores(terms: DataFrame, index: DataFrame, split: DataFrame) -> DataFrame:
    """case_idx, song_id, score: terms found through the index, phrases twice as much, in equal parts on
    their words; observed items are left out."""
    words = F.filter(F.split(normalize_text(F.col("term")), " "), lambda t: F.length(t) >= 3)
    parts = terms.select("case_idx", words.alias("w")).where("size(w) > 0").select("case_idx", F.explode("w").alias("token"), (F.when(F.size("w") > 1, 2.0).otherwise(1.0) / F.size("w")).alias("weight"))
    # the index is joined once for each word of the vocabulary, whose lists are short
    found = parts.groupBy("case_idx", "token").agg(F.sum("weight").alias("weight")).join(index, "token").groupBy("case_idx", "song_id").agg(F.sum("weight").alias("score"))
    return found.join(split.where("observed").select("case_idx", "song_id"), ["case_idx", "song_id"], "left_anti")
