"""Operators on hand-made collections, against values worked out by hand or by plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import text
from cadenza.functions import vocabulary as v
from cadenza.operators import adapter, candidates, cf, content, coverage, diversity, emotion, knowledge, metrics, profiles, scoring, split
from cadenza.sources import readers, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "raw,want",
    [("Hello (Live) [2011]", "hello"), ("a(b(c)d)e", "a d e"), ("Beyoncé", "beyonc"), ("  --  ", ""), (None, ""), ("R&B  Hits!", "r b hits")],
)
def test_normalize_text(spark, raw, want):
    assert one(spark, text.normalize_text(F.lit(raw))) == want


def test_bins_and_excerpt(spark):
    assert [one(spark, text.length_bin(F.lit(n))) for n in (0, 1, 10, 11, 100, 101)] == ["0", "1-10", "1-10", "11-20", "91-100", "100+"]
    assert one(spark, text.excerpt(F.lit("one  two three"), 9)) == "one two"
    assert one(spark, text.excerpt(F.lit("one two"), 9)) == "one two"


def tracks(spark, lists):
    rows = [(p, i + 1, s, s.upper(), s[0]) for p, songs in lists.items() for i, s in enumerate(songs)]
    return spark.createDataFrame(rows, "playlist_id long, pos int, song_id string, title string, artist string")


def test_holdout(spark):
    t = tracks(spark, {1: ["a", "b", "a", "c", "d"], 2: ["a"], 3: ["x", "y"]})
    rows = sorted((r.case_idx, r.song_id, r.rn, r.observed) for r in split.holdout(t, 2, 2).collect())
    assert rows == [(1, "a", 1, True), (1, "b", 2, True), (1, "c", 3, False), (1, "d", 4, False), (2, "x", 1, True), (2, "y", 2, False)]
    assert split.holdout(t, 0, 2).count() == 0


def test_cf_and_pools(spark):
    s = split.holdout(tracks(spark, {1: ["a", "b", "z"], 2: ["a", "b", "c", "z"], 3: ["a", "c", "d"]}), 1, 2)
    near = {(r.src, r.dst): r.weight for r in cf.neighbors(s).collect()}
    assert near[("a", "b")] == pytest.approx(2 / math.sqrt(6)) and near[("a", "c")] == pytest.approx(2 / math.sqrt(6))
    scores = {(r.case_idx, r.song_id): r.cf for r in cf.cf_scores(s, cf.neighbors(s)).collect()}
    assert scores[(1, "c")] == pytest.approx(2 / math.sqrt(6) + 1 / 2)
    pop = cf.popularity(s)
    pool = candidates.cf_pop_pool(cf.cf_scores(s, cf.neighbors(s)), pop, candidates.popular_unseen(s, cf.popular(pop)), 10)
    seen = s.where("observed")
    assert pool.join(seen, ["case_idx", "song_id"], "left_semi").count() == 0


def test_merge_in_turn(spark):
    lists = [["a", "b", "c"], ["b", "d"], ["a", "e", "f"]]
    frames = [spark.createDataFrame([(1, s, i + 1) for i, s in enumerate(x)], "case_idx int, song_id string, rank int") for x in lists]
    got = [r.song_id for r in candidates.merge(frames, 2, 5).orderBy("place").collect()]
    assert got == ["a", "b", "d", "c", "e"]
    assert candidates.quota(500, 0.25) == 125 and candidates.quota(10, 0.25) == 2 and candidates.quota(6, 0.75) == 4


def test_min_max(spark):
    rows = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 3.0), (2, 3.0), (3, 0.0)], "case_idx int, s double")
    got = sorted((r.case_idx, r.n) for r in rows.select("case_idx", scoring.min_max(F.col("s")).alias("n")).collect())
    assert got == [(1, 0.0), (1, 1.0), (2, 1.0), (2, 1.0), (3, 0.0)]


def test_metrics(spark):
    s = spark.createDataFrame([(1, "a", False), (1, "b", False), (1, "q", True), (2, "c", False), (2, "q", True)], "case_idx int, song_id string, observed boolean")
    ranked = spark.createDataFrame([("v", 1, "x", 1), ("v", 1, "a", 2), ("v", 2, "y", 1)], "variant string, case_idx int, song_id string, rank int")
    r = metrics.evaluate(ranked, s, 2).first()
    ideal = 1 + 1 / math.log2(3)
    assert r.recall == pytest.approx(0.25) and r.ndcg == pytest.approx(round(1 / math.log2(3) / ideal / 2, 6))


def test_coverage_and_diversity(spark):
    t = tracks(spark, {1: ["a1", "a2", "b1", "c1"], 2: ["z1"]})
    songs = spark.createDataFrame([("a1",), ("b1",), ("c1",)], "song_id string")
    marked = coverage.marked_tracks(t, songs)
    by = {r.playlist_id: (r.matched_song_count, r.matched_coverage_percent) for r in coverage.per_playlist(marked).collect()}
    assert by == {1: (3, 75), 2: (0, 0)}
    r = coverage.summary(marked).first()
    assert (r.total_playlists, r.partial_playlists, r.zero_match_playlists, r.unique_missing_tracks) == (2, 1, 1, 2)
    d = {r.playlist_id: r for r in diversity.playlist_stats(t).collect()}
    assert (d[1].top_artist, d[1].top_artist_share, d[1].is_artist_dominated, d[1].is_diverse) == ("a", "0.500000", 1, 0)


def test_labels(spark):
    check = lambda x, k: one(spark, profiles.normalize_label(F.lit(x), k))
    assert check("R&B", "genre_style") == "rnb" and check("Hip Hop", "genre_style") == "hiphop"
    assert check("dance", "genre_style") == "" and check("dance", "top_keywords") == "dancefloor"
    assert check("dramatic", "affect") == "" and check("medium", "energy") == "mid"
    row = spark.createDataFrame([(["x"], None, "loud")], "top_keywords array<string>, affect array<string>, energy string")
    got = row.select(*profiles.normalize_profile({c: F.col(c) for c in row.columns})).first()
    assert got.top_keywords == v.FALLBACK_KEYWORDS and got.affect == ["mixed"] and got.energy == "mid" and got.next_song_role == "same_vibe"


def test_song_profile(spark):
    songs = spark.createDataFrame([("s", "Tonight we dance", "A", "party club tonight dance sad"), ("e", "", "B", "")], "song_id string, title string, artist string, lyrics string")
    got = {r.song_id: r for r in profiles.song_profiles(songs).collect()}
    assert got["s"].top_keywords == ["party", "dancefloor", "high_arousal"] and got["s"].energy == "high" and got["s"].valence == "positive"
    assert got["s"].listening_context == "party" and got["s"].affect[0] == "euphoric"
    assert got["e"].top_keywords == v.FALLBACK_KEYWORDS and got["e"].listening_context == "mixed"
    vectors = emotion.song_vectors(profiles.song_profiles(songs))
    norms = {r.song_id: r.n for r in vectors.groupBy("song_id").agg(F.sum(F.col("value") ** 2).alias("n")).collect()}
    assert norms["s"] == pytest.approx(1)


def test_tfidf(spark):
    texts = spark.createDataFrame([("a", "Red fox red"), ("b", "blue fox")], "song_id string, text string")
    got = {(r.song_id, r.feature): r.value for r in content.tfidf(texts).collect()}
    idf = math.log(3 / 2) + 1
    raw = {"red": 2 * idf, "fox": 1.0, "red fox": idf, "fox red": idf}
    norm = math.sqrt(sum(x * x for x in raw.values()))
    assert {f: pytest.approx(x / norm) for f, x in raw.items()} == {f: x for (s, f), x in got.items() if s == "a"}


def test_svd(spark):
    rng = np.random.default_rng(0)
    x = rng.random((20, 3)) @ rng.random((3, 8))
    rows = [(i, f"f{j}", float(x[i, j])) for i in range(20) for j in range(8)]
    dense, values = knowledge.svd(spark.createDataFrame(rows, "id int, feature string, value double"), "id", 3)
    assert np.allclose(values, np.linalg.svd(x)[1][:3])
    got = np.array([r.vec for r in dense.orderBy("id").collect()])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert np.allclose(got @ got.T, unit @ unit.T, atol=1e-6)


def test_adapter_learns_an_order(spark):
    rng = np.random.default_rng(1)
    rows = [(c, f"s{i}", *(float(z) for z in rng.random(5))) for c in range(30) for i in range(12)]
    prepared = spark.createDataFrame(rows, "case_idx int, song_id string, cf_norm double, artist_norm double, pop_norm double, lemon_norm double, kar_norm double")
    truth = prepared.where("cf_norm > 0.8").select("case_idx", "song_id", F.lit(False).alias("observed"))
    rows = adapter.features(prepared, truth).persist()
    sample = adapter.pairs(rows, 1)
    net = adapter.train(sample, adapter.stats(rows, adapter.SCALARS), ("cf", "artist"), 1, hidden=8, epochs=80, rate=0.02)
    x = rng.random((200, 2))
    assert np.corrcoef(net.score(x), x[:, 0])[0, 1] > 0.8
    assert adapter.split_cases(rows, 1).where("not is_train").count() == 6
    assert adapter.rank(rows, net, "v").where("rank = 1").count() == 30


@pytest.mark.parametrize("names", [(), ("cf", "no such feature")])
def test_adapter_needs_features(names):
    with pytest.raises(ValueError):
        adapter.train(None, {}, names, 1)


def test_random_catalog_is_seeded_and_unseen(spark):
    t = tracks(spark, {p: [f"s{(p * 3 + i) % 40}" for i in range(6)] for p in range(20)})
    s = split.holdout(t, 1, 2)
    songs = spark.createDataFrame([(f"s{i}", "a") for i in range(40)], "song_id string, artist string")
    rows = candidates.random_catalog(s, songs, 5, 10)
    assert rows.groupBy("case_idx").count().where("count = 10").count() == 20
    assert rows.join(s.where("observed"), ["case_idx", "song_id"]).count() == 0
    assert sorted(rows.collect()) == sorted(candidates.random_catalog(s.repartition(7), songs.repartition(5), 5, 10).collect())
    assert rows.where("rank = 1").select("song_id").distinct().count() > 8
    everything = candidates.random_catalog(s, songs, 5, 100)
    assert everything.count() == 20 * 40 - s.where("observed").count()


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "catalog.csv").write_text('Song,ARTIST,text\nOne,A,"line 1\nline ""2"""\n,A,x\nOne (Live),a,other\nTwo,B,words\n')
    rows = readers.read_catalog(spark, str(tmp_path / "catalog.csv"))
    from cadenza.operators import catalog

    songs = catalog.first_wins(rows)
    assert {(r.song_id, r.lyrics) for r in songs.collect()} == {("a::one", 'line 1\nline "2"'), ("b::two", "words")}
    stats = catalog.scan_stats(rows).first()
    assert (stats.n_rows, stats.usable_rows, stats.duplicate_usable_keys) == (4, 3, 1)
    lists = tmp_path / "lists"
    lists.mkdir()
    (lists / "mpd.slice.2.json").write_text('{"playlists": [{"pid": 7, "name": "n", "tracks": [{"pos": 0, "track_name": "", "name": "Two", "artist": "B"}, {"title": "One", "artist_name": "A"}]}, {"name": "empty", "tracks": []}]}')
    (lists / "more.jsonl").write_text('{"pid": 9, "tracks": [{"track_name": "Nope", "artist_name": "C"}]}\n\n')
    got = {(r.playlist_id, r.pos, r.song_id) for r in readers.read_playlists(spark, str(lists)).collect()}
    assert got == {("7", 0, "b::two"), ("7", 1, "a::one"), ("empty", None, None), ("9", 0, "c::nope")}
    (tmp_path / "p.csv").write_text("pid,track_name,artist_name,pos\nx,Nope,C,0\nx,Two,B,3.0\nx,One,A,1\ny,One,A,2\n")
    got = sorted((r.playlist_id, r.pos, r.song_id) for r in readers.read_playlist_csv(spark, str(tmp_path / "p.csv"), songs).collect())
    # 3.0 is no whole number, so Two stands where its row does, at 1, beside One; of equal places the key decides
    assert got == [("x", 1, "a::one"), ("x", 2, "b::two"), ("y", 1, "a::one")]
    assert readers.read_playlist_csv(spark, str(tmp_path / "p.csv"), songs, 1).select("playlist_id").distinct().count() == 1
    (tmp_path / "cache.jsonl").write_text('{"cache_key": "k", "semantic": {"energy": "low"}}\nnot json\n\n{"cache_key": "k", "semantic": {"energy": "high", "affect": ["sad"]}}\n{"cache_key": "", "semantic": {}}\n')
    cache = readers.read_cache(spark, str(tmp_path / "cache.jsonl"))
    r = cache.first()
    assert cache.count() == 1 and r.energy == "high" and r.affect == ["melancholic"]
    keys = spark.createDataFrame([("k",), ("missing",)], "cache_key string")
    assert readers.strict_lookup(keys.limit(1), cache).count() == 1
    with pytest.raises(Exception, match="missing"):
        readers.strict_lookup(keys, cache).collect()
    out = str(tmp_path / "out")
    sinks.append_cache(cache, f"{out}/cache")
    sinks.append_cache(cache, f"{out}/cache")
    assert readers.read_cache(spark, f"{out}/cache").count() == 1
    t = tracks(spark, {1: ["a::one", "b::two"]})
    marked = coverage.marked_tracks(t, songs)
    sinks.write_marked(marked, f"{out}/marked")
    sinks.write_marked(marked.limit(0), f"{out}/marked")
    assert spark.read.json(f"{out}/marked").first().matched_coverage_percent == 100
    sinks.write_filtered(marked, f"{out}/filtered")
    sinks.write_eval_ids(split.holdout(t, 1, 2), f"{out}/ids")
    assert spark.read.option("header", True).csv(f"{out}/ids").first().heldout_count == "1"
    with pytest.raises(ValueError):
        readers.find_column(["a"], readers.TITLE)
    assert readers.find_column(["Track_Name"], ("track name",), loose=True) == "Track_Name"
