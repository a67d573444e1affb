"""Files in several parts, caches that grow, marking runs, and what composes them."""

import json

import pytest
from pyspark.sql import functions as F

from cadenza.functions.jsontext import profile_of_text
from cadenza.functions.text import compact_key, percent_text
from cadenza.operators import assembly, catalog, coverage, profiles, split
from cadenza.sources import readers, sinks


def profile_rows(spark, rows):
    return spark.createDataFrame(rows, "cache_key string, energy string, affect array<string>")


def test_the_last_append_wins(spark, tmp_path):
    path = str(tmp_path / "cache")
    sinks.append_cache(profile_rows(spark, [("k", "low", ["sad"]), ("l", "mid", ["dark"])]), path)
    # longer, so Spark reads its file first
    sinks.append_cache(profile_rows(spark, [("k", "high", ["euphoric", "playful", "romantic"] * 40)]), path)
    sinks.append_cache(profile_rows(spark, [("m", "low", ["dark"])]), path)
    assert {r.cache_key: r.energy for r in readers.read_cache(spark, path).collect()} == {"k": "high", "l": "mid", "m": "low"}
    # lines without a sequence number: the later file and line counts, records of this engine before none
    (tmp_path / "plain").mkdir()
    line = lambda k, e, pad="": json.dumps({"cache_key": k, "semantic": {"energy": e, "listening_context": "party" + pad}}) + "\n"
    (tmp_path / "plain" / "c2.jsonl").write_text(line("k", "low") + line("k", "mid"))
    (tmp_path / "plain" / "c10.jsonl").write_text(line("k", "high", "x" * 500))
    assert readers.read_cache(spark, str(tmp_path / "plain")).first().energy == "high"


def test_catalog_over_several_files(spark, tmp_path):
    (tmp_path / "a1.csv").write_text("song,artist,text\nOne,A,first\nTwo,B,x\n")
    (tmp_path / "a2.csv").write_text("song,artist,text\nOne,A,second and much longer\n" + "".join(f"S{i},C,words\n" for i in range(50)))
    (tmp_path / "a10.csv").write_text("song,artist,text\nTwo,B,last\nS3,C,last\n")
    rows = readers.read_catalog(spark, str(tmp_path))
    assert sorted(r.ord for r in rows.collect()) == list(range(55))
    songs = {r.song_id: r.lyrics for r in catalog.first_wins(rows).collect()}
    assert songs["a::one"] == "first" and songs["b::two"] == "x" and songs["c::s3"] == "words"


def test_files_in_order(spark, tmp_path):
    for name in ("mpd.slice.10.json", "mpd.slice.2.json", "more.jsonl", "notes.txt"):
        (tmp_path / name).write_text('{"pid": 1, "tracks": []}\n')
    names = lambda **k: [p.rsplit("/", 1)[1] for p in readers.playlist_files(spark, str(tmp_path), **k)]
    assert names() == ["more.jsonl", "mpd.slice.2.json", "mpd.slice.10.json"]
    assert names(natural=False) == ["mpd.slice.10.json", "mpd.slice.2.json", "more.jsonl"]
    assert names(max_files=2) == ["more.jsonl", "mpd.slice.2.json"]
    assert readers.playlist_files(spark, f"{tmp_path}/more.jsonl") == [f"{tmp_path}/more.jsonl"]
    assert readers.default_playlists(spark, str(tmp_path)) == str(tmp_path)
    (tmp_path / "empty" / "playlists").mkdir(parents=True)
    assert readers.default_playlists(spark, f"{tmp_path}/empty") is None
    assert readers.default_playlist_csv(spark, str(tmp_path)) is None
    (tmp_path / "playlist.csv").write_text("pid\n")
    assert readers.default_playlist_csv(spark, str(tmp_path), f"{tmp_path}/none.csv") == f"{tmp_path}/playlist.csv"


def test_cases_from_files(spark, tmp_path):
    (tmp_path / "catalog.csv").write_text("song,artist,text\n" + "".join(f"S{i},A,words\n" for i in range(6)))
    lists = tmp_path / "lists"
    lists.mkdir()
    track = lambda i: {"track_name": f"S{i}", "artist_name": "A"}
    for no, pids in ((1, (0, 1)), (2, (2, 3))):
        (lists / f"mpd.slice.{no}.json").write_text(json.dumps({"playlists": [{"pid": p, "tracks": [track(p), track(p + 1), track(p + 2)] if p != 1 else [track(99)]} for p in pids]}))
    songs, cases = readers.load_cases(spark, f"{tmp_path}/catalog.csv", str(lists), max_playlists=2, least=3, holdout_k=1)
    assert {r.playlist_id for r in cases.collect()} == {"0", "2"}
    assert {r.song_id for r in songs.collect()} == {f"a::s{i}" for i in range(5)}


def test_demo(spark):
    songs, tracks = readers.demo(spark)
    assert songs.count() == 8 and split.holdout(tracks, 1, 3, None).where("not observed").count() == 2


def test_marking_runs(spark, tmp_path):
    path = f"{tmp_path}/marked"
    rows = [(p, i, f"s{i}", f"T{i}", "A", i % 2 == 0, p // 2) for p in range(4) for i in range(3)]
    marked = spark.createDataFrame(rows, "playlist_id long, pos int, song_id string, title string, artist string, matched boolean, slice long")
    got = lambda df: tuple(df.first())
    assert got(sinks.write_marked(marked, path, dry_run=True)) == (2, 4, 12, 8, 0, 0) and not readers.exists(spark, path)
    assert got(sinks.write_marked(marked.where("slice = 0"), path)) == (1, 2, 6, 4, 0, 1)
    assert got(sinks.write_marked(marked, path)) == (2, 4, 12, 8, 1, 1)
    assert got(sinks.write_marked(marked.withColumn("matched", F.lit(True)), path)) == (2, 4, 12, 12, 2, 0)
    out = spark.read.json(path)
    assert out.count() == 4 and {r.matched_song_count for r in out.collect()} == {2}
    assert got(sinks.write_marked(marked.where("slice = 1").withColumn("matched", F.lit(True)), path, force=True)) == (1, 2, 6, 6, 0, 1)
    assert sorted((r.slice, r.matched_song_count) for r in spark.read.json(path).collect()) == [(0, 2), (0, 2), (1, 3), (1, 3)]


def test_filtered_rows_have_all_columns(spark):
    rows = spark.createDataFrame([(1, i, f"s{i}", "T", "A", "List", None, True) for i in range(2)], "playlist_id long, pos int, song_id string, title string, artist string, name string, album string, matched boolean")
    out = coverage.filtered_rows(rows, "50_percent", whole=True)
    assert out.columns == ["playlist_id", "playlist_name", "original_track_count", "matched_song_count", "matched_coverage_percent", "pos", "track_name", "artist_name", "album_name", "song_id"]
    assert out.first().playlist_name == "List" and out.first().album_name == ""


@pytest.mark.parametrize(
    "text,energy,affect",
    [
        ('{"energy": "low", "affect": ["a", "b"]}', "low", ["a", "b"]),
        (' {"energy": "low"} ', "low", None),
        ("[1, 2]", None, None),
        ("7", None, None),
        ('Here: {"energy": "high", "affect": "x"} ok', "high", ["x"]),
        ("{not json} energy: low", None, None),
        ("energy: low,\n`energy = 'high'`\naffect: ['a', \"b\"],", "high", ["a", "b"]),
        ("affect: sad", None, ["sad"]),
        ("", None, None),
        (None, None, None),
    ],
)
def test_profiles_out_of_text(spark, text, energy, affect):
    row = spark.createDataFrame([(text,)], "t string").select(profile_of_text(F.col("t")).alias("p")).first().p
    assert (row.energy, row.affect) == (energy, affect)


def test_profiles_through_a_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    songs = spark.createDataFrame([(f"s{i}", "T", "A", "party dance tonight") for i in range(5)], "song_id string, title string, artist string, lyrics string")
    calls = []

    def provider(rows):
        calls.append(sorted(r.song_id for r in rows.collect()))
        return profiles.song_profiles(rows).withColumn("energy", F.lit("low"))

    assembly.PROVIDERS["test"] = provider
    run = lambda **k: {r.song_id: r.energy for r in assembly.cached_songs(songs, path, "test", **k).collect()}
    assert run(most=2) == {"s0": "low", "s1": "low", "s2": "high", "s3": "high", "s4": "high"}
    assert run(most=2) == {"s0": "low", "s1": "low", "s2": "low", "s3": "low", "s4": "high"}
    assert run() == dict.fromkeys(("s0", "s1", "s2", "s3", "s4"), "low")
    assert calls == [["s0", "s1"], ["s2", "s3"], ["s4"]]
    assert run(force=True) == dict.fromkeys(("s0", "s1", "s2", "s3", "s4"), "low") and calls[-1] == ["s0", "s1", "s2", "s3", "s4"]


def test_keys_and_percents(spark):
    import hashlib

    row = spark.range(1).select(compact_key(F.lit("v"), F.lit('a"b'), F.array(F.lit("x"), F.lit("y"))).alias("k"), percent_text(F.lit(1), F.lit(3)).alias("p"), percent_text(F.lit(1), F.lit(0)).alias("q")).first()
    assert row.k == hashlib.sha1(json.dumps(["v", 'a"b', ["x", "y"]], separators=(",", ":")).encode()).hexdigest()
    assert (row.p, row.q) == ("33.33%", "0.00%")
