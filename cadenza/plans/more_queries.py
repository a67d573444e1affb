"""Further queries: sources and sinks round trips, semantic terms of the fusion, Stage-1 comparison, the text
operators on real texts, and the split without a cap."""

from __future__ import annotations

from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions import vocabulary as v
from cadenza.functions.jsontext import profile_of_text
from cadenza.operators import assembly, casewise, catalog, content, coverage, metrics, profiles, scoring, semantic, split
from cadenza.operators import candidates as cand
from cadenza.plans import views
from cadenza.plans.queries import QUERIES, SEED, Whole, _cut, new_folder, query, whole_query
from cadenza.plans.queries import Model as Base
from cadenza.sources import readers, sinks


class Real(Whole):
    """Every eligible playlist, and the texts that the documents really hold."""

    @cached_property
    def real_index(self) -> DataFrame:
        return profiles.token_index(self.eval_songs)

    @cached_property
    def real_tfidf(self) -> DataFrame:
        return _cut(content.tfidf(content.content_text(self.eval_songs, chars=1 << 30)))


def real_query(f):
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Real(spark, sf_dir))
    return f


# ---- sources and sinks


@query
def cache_last_wins(m: Base) -> DataFrame:
    """Three appends to a cache; a key's last record counts."""
    keys = views.parts(m.spark, m.sf_dir).select(F.col("p_partkey").cast("string").alias("cache_key"), "p_partkey")
    path = new_folder(m.spark, "cache") + "/songs"
    for step, energy, affect in ((1, "low", "dark"), (2, "high", "euphoric"), (3, "mid", "chill")):
        values = {"energy": F.lit(energy), "affect": F.array(F.lit(affect), *([F.lit("playful"), F.lit("romantic")] if step == 2 else [])), "valence": F.lit("positive")}
        rows = keys.where(F.col("p_partkey") % step == 0).select("cache_key", *(values[k].alias(k) for k in values))
        sinks.append_cache(rows, path)
    return readers.read_cache(m.spark, path).select("cache_key", "energy", F.array_join("affect", "|").alias("affect"), "valence")


@query
def catalog_of_files(m: Base) -> DataFrame:
    """The catalog written as several files and read again: of one key the first row counts."""
    path = new_folder(m.spark, "catalog") + "/rows"
    rows = views.catalog_rows(m.spark, m.sf_dir)
    rows = rows.select("ord", F.col("title").alias("Song"), F.col("artist").alias("ARTIST"), F.concat(F.md5("lyrics"), F.lit(', "'), F.col("ord").cast("string"), F.lit('"')).alias("text"))
    ordered = rows.repartitionByRange(7, "ord").sortWithinPartitions("ord").drop("ord")
    ordered.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return catalog.first_wins(readers.read_catalog(m.spark, path)).select("song_id", "title", "artist", "lyrics")


def _written_playlists(m: Base) -> str:
    """The playlists as JSON lines in numbered slices."""
    path = new_folder(m.spark, "playlists") + "/lists"
    track = F.struct("pos", F.col("title").alias("track_name"), F.col("artist").alias("artist_name"), F.lit("Album").alias("album_name"))
    lists = m.tracks.groupBy(F.col("playlist_id").alias("pid")).agg(F.sort_array(F.collect_list(track)).alias("tracks"))
    lists.repartitionByRange(5, "pid").sortWithinPartitions("pid").write.json(path)
    hadoop, fs = readers._file_system(m.spark, path)
    names = sorted(s.getPath().getName() for s in fs.listStatus(hadoop) if s.getPath().getName().startswith("part-"))
    for i, name in enumerate(names):
        file = m.spark._jvm.org.apache.hadoop.fs.Path
        fs.rename(file(f"{path}/{name}"), file(f"{path}/mpd.slice.{i}.jsonl"))
    return path


@query
def playlist_files_scan(m: Base) -> DataFrame:
    """Playlists out of their files: matched tracks; playlists without any go."""
    lists = readers.matched_playlists(readers.read_playlists(m.spark, _written_playlists(m)), m.songs)
    return lists.select(F.col("playlist_id").cast("long").alias("playlist_id"), F.col("pos").cast("long").alias("pos"), "song_id", "album")


@query
def playlist_files_first(m: Base) -> DataFrame:
    """The first 100 playlists with matches."""
    lists = readers.matched_playlists(readers.read_playlists(m.spark, _written_playlists(m)), m.songs, 100)
    return lists.groupBy(F.col("playlist_id").cast("long").alias("playlist_id")).agg(F.count("*").alias("n"))


@query
def marker_totals(m: Base) -> DataFrame:
    """Totals of a marking run over slices of 100 playlists, of which those below 5 have been marked."""
    marked = m.marked.withColumn("slice", F.expr("playlist_id div 100"))
    done = marked.select("slice").distinct().where("slice < 5")
    return sinks.marking_totals(marked, done)


@query
def coverage_report(m: Base) -> DataFrame:
    return coverage.report(m.marked)


@query
def demo_split(m: Base) -> DataFrame:
    _, tracks = readers.demo(m.spark)
    return split.holdout(tracks, 1, 3, None).select("playlist_id", "song_id", "rn", "n", "observed")


@query
def json_profile_extract(m: Base) -> DataFrame:
    """Profiles out of texts as a model writes them: JSON, JSON inside of other text, lines, neither, no object."""
    n = F.col("event_id")
    texts = F.element_at(
        F.array(
            F.concat(F.lit('{"energy": "high", "affect": ["sad", "'), F.col("event_type"), F.lit('"], "valence": "positive"}')),
            F.concat(F.lit('Sure, here it is:\n{"energy": "low",\n "affect": "'), F.col("event_type"), F.lit('"}\nDone.')),
            F.concat(F.lit("energy: high\n`energy = mid`,\naffect: ['sad', '"), F.col("event_type"), F.lit("'],\nvalence: \"negative\"\nother: x")),
            F.lit("nothing of the kind"),
            F.lit('["energy", "high"]'),
        ),
        (F.pmod(n, F.lit(5)) + 1).cast("int"),
    )
    rows = views.table(m.spark, m.sf_dir, "events").select("event_id", profile_of_text(texts).alias("p"))
    return rows.select("event_id", F.col("p.energy").alias("energy"), F.array_join("p.affect", "|").alias("affect"), F.col("p.valence").alias("valence"))


@query
def profile_assembly(m: Base) -> DataFrame:
    """Song profiles from a CSV where it has them, else from the word lists."""
    path = new_folder(m.spark, "profiles") + "/songs"
    given = m.song_profiles.where("length(song_id) % 2 = 0").select("song_id", F.lit("chill|dark").alias("top_keywords"), F.lit("low").alias("energy"), F.lit("negative").alias("valence"))
    given.write.option("header", True).csv(path)
    rows = assembly.song_profiles(m.spark, m.worded, path)
    return rows.select("song_id", F.array_join("top_keywords", "|").alias("top_keywords"), "energy", "valence")


@query
def cached_song_profiles(m: Base) -> DataFrame:
    """Profiles through a cache that a first run of 100 has begun; both runs give every song's profile."""
    path = new_folder(m.spark, "cache") + "/songs"
    first = assembly.cached_songs(m.worded, path, most=100)
    second = assembly.cached_songs(m.worded, path)
    flat = lambda df, run: df.select(F.lit(run).alias("run"), "song_id", *(F.array_join(k, "|").alias(k) if k in v.LIST_KEYS else F.col(k) for k in v.KEYS))
    return flat(first, 1).unionByName(flat(second, 2))


# ---- the semantic term


def _with_semantic(m: Base) -> DataFrame:
    scores = profiles.profile_scores(m.pool, m.list_profiles, m.song_profiles)
    norm = scores.select("case_idx", "song_id", scoring.min_max(F.col("semantic")).alias("semantic_norm"))
    return m.with_emotion.join(norm, ["case_idx", "song_id"])


SEMANTIC_VARIANTS = {
    "CF + metadata + semantic": {"cf": 0.35, "artist": 0.10, "pop": 0.10, "semantic": 0.01},
    "CF + metadata + semantic + LEMON": {"cf": 0.35, "artist": 0.10, "pop": 0.10, "semantic": 0.01, "lemon": 0.01},
}


@query
def semantic_norms(m: Base) -> DataFrame:
    return _with_semantic(m).select("case_idx", "song_id", F.round("semantic_norm", 6).alias("semantic_norm"))


@query
def semantic_variants(m: Base) -> DataFrame:
    return metrics.evaluate(scoring.rank_variants(_cut(_with_semantic(m)), SEMANTIC_VARIANTS), m.split)


@query
def text_fallback_scores(m: Base) -> DataFrame:
    """Scores of candidates by the terms of the playlist's profile in their text, where songs have no profile."""
    return semantic.text_scores(m.pool, profiles.semantic_terms(m.list_profiles), m.worded)


@query
def profile_route_topk(m: Base) -> DataFrame:
    """Every unobserved song by its profile's likeness to the playlist's, the best 500."""
    rows = semantic.profile_route(m.split, m.list_profiles, m.song_profiles, m.pop)
    return rows.select("case_idx", "song_id", F.round("semantic", 6).alias("semantic"), "rank")


def _routes(m: Base) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Pool and score in the CF slot, by Stage-1 route."""
    text = _cut(semantic.text_route(m.split, profiles.semantic_terms(m.list_profiles), profiles.token_index(m.worded), m.pop))
    by_profile = _cut(semantic.profile_route(m.split, m.list_profiles, m.song_profiles, m.pop))
    ordered = by_profile.select("case_idx", "song_id", "rank")
    return {
        "CF": (m.base, m.cf),
        "Direct text": (cand.merge([text, m.unseen], 0, 500), text.withColumnRenamed("score", "cf")),
        "Profile": (cand.merge([ordered, m.unseen], 0, 500), None),
    }


@query
def semantic_rerank(m: Base) -> DataFrame:
    """Stage-1 routes by CF, by the text of the playlist's profile and by profiles: the share of held-out items in
    the pool, and the metrics after a rerank in which the route's score stands in the place of CF's."""
    out = None
    for name, (pool, score) in _routes(m).items():
        pool = _cut(pool)
        if score is None:  # also what popularity filled the pool with has a likeness
            score = profiles.profile_scores(pool, m.list_profiles, m.song_profiles).withColumnRenamed("semantic", "cf")
        ranked = scoring.rank_variants(scoring.prepare(m.split, m.artists, pool, score, m.pop), {name: {"cf": 0.35, "artist": 0.10, "pop": 0.10}})
        own = metrics.evaluate(ranked, m.split).join(cand.recall_of(pool.withColumn("variant", F.lit(name)), m.split, ("variant",)).withColumnRenamed("recall", "pool_recall"), "variant")
        out = own if out is None else out.unionByName(own)
    return out


@query
def stage1_modes(m: Base) -> DataFrame:
    """The fusion over the pools of the other two modes: CF and popularity, and the two routes in turn."""
    pools = {"CF Stage1": m.base, "Hybrid Stage1": cand.merge([m.cf_ranked, m.content_ranked, m.unseen], 2, 500)}
    out = None
    for name, pool in pools.items():
        prepared = scoring.prepare(m.split, m.artists, _cut(pool), m.cf, m.pop)
        variants = {f"{name} x CF": {"cf": 0.35}, f"{name} x metadata": {"artist": 0.10, "pop": 0.10}, f"{name} x CF + metadata": {"cf": 0.35, "artist": 0.10, "pop": 0.10}}
        own = metrics.evaluate(scoring.rank_variants(prepared, variants), m.split)
        out = own if out is None else out.unionByName(own)
    return out


@query
def random_catalog_ranking(m: Base) -> DataFrame:
    """The whole catalog in a seeded order of its own for each case."""
    ranked = cand.random_catalog(m.split, m.artists, SEED, 10)
    return metrics.evaluate(ranked.withColumn("variant", F.lit("Random catalog")), m.split)


# ---- the learned re-ranker without the encoder's columns


def _scalars(m: Base) -> DataFrame:
    rows = m.with_emotion.select("case_idx", "song_id", F.col("cf_norm").alias("cf"), F.col("artist_norm").alias("artist"), F.col("pop_norm").alias("popularity"), F.col("lemon_norm").alias("lemon"))
    truth = m.split.where("not observed").select("case_idx", "song_id", F.lit(1).alias("label"))
    products = {f"{a}_{b}": F.col(a) * F.col(b) for a, b in (("cf", "artist"), ("cf", "popularity"), ("cf", "lemon"))}
    return rows.withColumns(products).join(truth, ["case_idx", "song_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


SCALAR_NAMES = ("cf", "artist", "popularity", "lemon", "cf_artist", "cf_popularity", "cf_lemon")


def _scalar_columns(b) -> dict[str, np.ndarray]:
    own = {"popularity" if n == "pop" else n: x for n, x in b.norms.items()}
    return {n: own[n] if n in own else own[n.split("_")[0]] * own[n.split("_")[1]] for n in SCALAR_NAMES}


@whole_query
def adapter_scalar_features(m: Base) -> DataFrame:
    if m.known is not None:
        emit = lambda b: [casewise.case_rows(b, b.pool, **_scalar_columns(b), label=b.labels.astype(np.int32))]
        rows = m._of_cases(emit, f"case_idx int, song_id string, {', '.join(f'{n} double' for n in SCALAR_NAMES)}, label int", m.items_felt)
        return rows.select("case_idx", "song_id", *(F.round(n, 6).alias(n) for n in SCALAR_NAMES), "label")
    return _scalars(m).select("case_idx", "song_id", *(F.round(n, 6).alias(n) for n in SCALAR_NAMES), "label")


@whole_query
def adapter_scalar_stats(m: Base) -> DataFrame:
    if m.known is not None:
        def emit(b):
            for n, x in _scalar_columns(b).items():
                x = x[b.valid]
                yield n, len(x), x.sum(), (x * x).sum()

        total = casewise.sums(m.cases, m.items_felt, emit, {"feature": "string"}, 2)
        mean = F.col("s0") / F.col("n")
        return total.select("feature", F.round(mean, 6).alias("mean"), F.round(F.sqrt(F.greatest(F.col("s1") / F.col("n") - mean * mean, F.lit(0.0))), 6).alias("std"))
    rows = _scalars(m)
    one = rows.agg(*(F.struct(F.lit(n).alias("feature"), F.round(F.avg(n), 6).alias("mean"), F.round(F.stddev_pop(n), 6).alias("std")).alias(n) for n in SCALAR_NAMES))
    return one.select(F.explode(F.array(*SCALAR_NAMES)).alias("x")).select("x.*")


# ---- real texts


@real_query
def token_index_texts(m: Real) -> DataFrame:
    """Words of the documents themselves."""
    return m.real_index


@real_query
def tfidf_weights_texts(m: Real) -> DataFrame:
    return m.real_tfidf.select("song_id", "feature", F.round("value", 6).alias("value"))


@real_query
def content_route_texts(m: Real) -> DataFrame:
    return m.content_of(m.real_tfidf).select("case_idx", "song_id", F.round("content", 6).alias("content"), "content_rank")


# ---- without a cap on the cases

#: Queries on the split that also run over every eligible playlist, under their name and `_whole`.
WHOLE = (
    "holdout_split",
    "eval_ids",
    "case_artist_split",
    "popularity_counts",
    "popularity_order",
    "cooccurrence_counts",
    "cf_neighbors",
    "cf_scores_topk",
    "stage1_recall_grid",
    "rank_fused_top10",
    "metrics_by_variant",
    "direct_text_scores",
    "lemon_rank",
)


def _whole(name: str):
    from cadenza.plans import queries

    f = getattr(queries, name)
    return lambda spark, sf_dir: f(Whole(spark, sf_dir))


QUERIES |= {f"{name}_whole": _whole(name) for name in WHOLE}
