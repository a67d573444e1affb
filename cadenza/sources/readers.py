"""Readers of catalogs, playlists, profiles and caches. Paths go to Spark's readers, never to open()."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions import vocabulary as v
from cadenza.functions.text import first_filled, song_key
from cadenza.operators.catalog import first_wins
from cadenza.operators.profiles import normalize_profile
from cadenza.operators.split import holdout

# The headers that files may have.
TITLE = ("song", "track_name", "track", "title", "name")
ARTIST = ("artist", "artist_name", "artists")
LYRICS = ("text", "lyrics", "lyric")
PLAYLIST = ("playlist_id", "pid", "playlist", "user_id")
POSITION = ("pos", "position", "track_pos", "order", "index")
_TRACK = "struct<pos: int, track_name: string, name: string, title: string, artist_name: string, artist: string, album_name: string, album: string, track_uri: string>"
_LIST = f"pid: string, name: string, tracks: array<{_TRACK}>"


def find_column(columns: list[str], options: tuple[str, ...], loose: bool = False) -> str:
    """The first option that is a column, by lower case; `loose` also takes `Track_Name` for `track name`, and of
    columns that fall together the last."""
    fold = (lambda c: re.sub("[^a-z0-9]+", " ", c.lower()).strip()) if loose else str.lower
    names: dict[str, str] = {}
    for c in columns:
        if loose or fold(c) not in names:
            names[fold(c)] = c
    for o in options:
        if fold(o) in names:
            return names[fold(o)]
    raise ValueError(f"none of {options} in {columns}")


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def natural_key(name: Column) -> Column:
    """The number in a file's name, by which slices are ordered."""
    return F.coalesce(F.regexp_extract(name, r"(\d+)", 1).try_cast("long"), F.lit(0))


def numbered(raw: DataFrame, name: str = "ord") -> DataFrame:
    """Rows of files with their number from 0: files by the number in their name, then by path, rows as they
    stand. Rows are counted by block of a file (the only thing that is put in one order), not sorted."""
    rows = raw.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__row"))
    blocks = rows.groupBy("__file", "__start").agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))
    order = Window.orderBy(natural_key(F.element_at(F.split("__file", "/"), -1)), "__file", "__start")
    blocks = blocks.select("__file", "__start", "__first", (F.sum("__n").over(order) - F.col("__n")).alias("__before"))
    # within a block of a file running numbers have no gaps
    at = F.col("__before") + F.col("__row") - F.col("__first")
    return rows.join(blocks, ["__file", "__start"]).withColumn(name, at).drop("__file", "__start", "__row", "__first", "__before")


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop, fs = _file_system(spark, path)
    return fs.exists(hadoop)


def playlist_files(spark: SparkSession, path: str, natural: bool = True, max_files: int = 0) -> list[str]:
    """The JSON and JSON-lines files of a folder (or the one file), once each: by the number in their names, or
    by name with all .json before all .jsonl; the first `max_files` if it isn't 0."""
    hadoop, fs = _file_system(spark, path)
    if fs.isFile(hadoop):
        return [path]
    names = sorted({s.getPath().getName() for s in fs.listStatus(hadoop) if s.isFile() and s.getPath().getName().endswith((".json", ".jsonl"))})
    if natural:
        found = [(int(m[0]) if (m := re.search(r"\d+", n)) else 0, n) for n in names]
        names = [n for _, n in sorted(found)]
    else:
        names.sort(key=lambda n: (n.endswith(".jsonl"), n))
    return [f"{path.rstrip('/')}/{n}" for n in names[: max_files or None]]


def default_playlists(spark: SparkSession, folder: str) -> str | None:
    """The folder of playlist slices: the data folder or its `playlists`."""
    for path in (folder, f"{folder}/playlists"):
        hadoop, fs = _file_system(spark, path)
        if fs.exists(hadoop) and any(re.fullmatch(r"mpd\.slice\..*\.json", s.getPath().getName()) for s in fs.listStatus(hadoop)):
            return path
    return None


def default_playlist_csv(spark: SparkSession, folder: str, filtered: str | None = None) -> str | None:
    """The filtered playlists where they exist, else a playlist CSV of the data folder."""
    options = [*([filtered] if filtered else []), f"{folder}/playlists.csv", f"{folder}/playlist.csv"]
    return next((p for p in options if exists(spark, p)), None)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """ord, song_id, title, artist, lyrics of every row of a catalog CSV, or of a folder of them; `ord` is the
    row's number in the order of the files."""
    raw = numbered(_csv(spark, path), "__ord")
    title, artist, lyrics = (F.trim(F.coalesce(F.col(f"`{find_column(raw.columns, o)}`"), F.lit(""))) for o in (TITLE, ARTIST, LYRICS))
    return raw.select(F.col("__ord").alias("ord"), song_key(title, artist).alias("song_id"), title.alias("title"), artist.alias("artist"), lyrics.alias("lyrics"))


def read_playlists(spark: SparkSession, path: str, max_files: int = 0) -> DataFrame:
    """playlist_id, name, pos, song_id, title, artist, album of every track, from JSON files (an object with
    `playlists`, or a list of playlists) and JSON lines; a folder may hold both. `file_key` is the number in the
    file's name, `list_no` gives the order of the playlists. Playlists without tracks have one row with a
    null pos."""
    schema = f"playlists array<struct<{_LIST}>>, pid string, name string, tracks array<{_TRACK}>"
    files = playlist_files(spark, path, max_files=max_files)
    rows = None
    for kind, suffix in enumerate((".json", ".jsonl")):
        own = [f for f in files if f.endswith(suffix)]
        if not own:
            continue
        raw = spark.read.schema(schema).option("multiLine", suffix == ".json").json(own)
        raw = numbered(raw.select("*", F.col("_metadata"), F.col("_metadata.file_name").alias("__name")), "__ord")
        each = raw.select(
            F.col("__name").alias("file"),
            "__ord",
            F.lit(kind).cast("long").alias("kind"),
            F.posexplode(F.coalesce("playlists", F.array(F.struct("pid", "name", "tracks")))).alias("at", "p"),
        )
        rows = each if rows is None else rows.unionByName(each)
    if rows is None:
        raise ValueError(f"no playlists in {path}")
    t = "t"
    title = first_filled(F.col(f"{t}.track_name"), F.col(f"{t}.name"), F.col(f"{t}.title"))
    artist = first_filled(F.col(f"{t}.artist_name"), F.col(f"{t}.artist"))
    list_no = F.shiftleft("kind", 61) + F.shiftleft("__ord", 24) + F.col("at")
    each = rows.select("file", list_no.alias("list_no"), "p.pid", "p.name", F.posexplode_outer("p.tracks").alias("idx", "t"))
    return each.select(
        F.coalesce("pid", "name", F.concat_ws(":", "file", F.col("list_no").cast("string"))).alias("playlist_id"),
        "name",
        natural_key(F.col("file")).alias("file_key"),
        "list_no",
        F.when(F.col("t").isNotNull(), F.coalesce(F.col("t.pos"), F.col("idx"))).alias("pos"),
        F.when(F.col("t").isNotNull(), song_key(title, artist)).alias("song_id"),
        title.alias("title"),
        artist.alias("artist"),
        first_filled(F.col("t.album_name"), F.col("t.album")).alias("album"),
    )


def matched_playlists(lists: DataFrame, songs: DataFrame, max_playlists: int = 0) -> DataFrame:
    """The tracks that the catalog has; playlists without any go, and of the others the first `max_playlists`
    stay if it isn't 0."""
    rows = lists.join(songs.select("song_id").distinct(), "song_id", "left_semi")
    if max_playlists:
        first = rows.groupBy("list_no").agg(F.count("*").alias("__n")).orderBy("list_no").limit(max_playlists)
        rows = rows.join(first.select("list_no"), "list_no", "left_semi")
    return rows


def read_playlist_csv(spark: SparkSession, path: str, songs: DataFrame, max_playlists: int | None = None) -> DataFrame:
    """playlist_id, song_id, pos (place among the playlist's matched tracks), list_no (order of the playlists by
    their first matched row, up to `max_playlists`). A position that isn't a whole number is the row's number."""
    raw = numbered(_csv(spark, path), "__ord")
    pid, title, artist = (F.col(f"`{find_column(raw.columns, o)}`") for o in (PLAYLIST, ("track_name", "song", "track", "title", "name"), ARTIST))
    at = next((c for c in POSITION if c in raw.columns), None)
    # int() takes digits with a sign and spaces around, nothing else
    given = F.trim((F.col(f"`{at}`") if at else F.lit(None)).cast("string"))
    whole = F.when(given.rlike(r"^[+-]?\d+$"), given.try_cast("long"))
    rows = raw.select(F.coalesce(pid.cast("string"), F.lit("")).alias("playlist_id"), song_key(title, artist).alias("song_id"), F.col("__ord").alias("ord"), F.coalesce(whole, F.col("__ord")).alias("p"))
    rows = rows.join(songs.select("song_id"), "song_id", "left_semi")
    first = rows.groupBy("playlist_id").agg(F.min("ord").alias("first"))
    if max_playlists:
        first = first.orderBy("first").limit(max_playlists)
    numbered_ = first.withColumnRenamed("first", "list_no")
    pos = F.row_number().over(Window.partitionBy("playlist_id").orderBy("p", "song_id"))
    return rows.join(numbered_, "playlist_id").select("playlist_id", "song_id", pos.alias("pos"), "list_no")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """cache_key and the profile of each key's last record; lines that aren't records with both are skipped. A
    record's `seq` (`append_cache` writes the time) tells which is later, then its place in the files."""
    profile = ", ".join(f"{k}: {'array<string>' if k in v.LIST_KEYS else 'string'}" for k in v.KEYS)
    # Spark takes two scans of one folder for the same, however the folder has grown between them; not so with
    # different options
    lines = numbered(spark.read.option("cadenza.read", uuid.uuid4().hex).text(path).select("value", "_metadata"), "__ord")
    rows = lines.select("__ord", F.from_json("value", f"cache_key string, seq long, semantic struct<{profile}>").alias("r"))
    good = rows.where("r.cache_key != '' and r.semantic is not null")
    last = good.groupBy(F.col("r.cache_key").alias("cache_key")).agg(F.max_by("r.semantic", F.struct(F.coalesce("r.seq", F.lit(0)), "__ord")).alias("s"))
    return last.select("cache_key", *normalize_profile({k: F.col(f"s.{k}") for k in v.KEYS}))


def load_cases(spark: SparkSession, catalog: str, playlists: str, max_playlists: int = 0, max_cases: int = 0, least: int = 20, holdout_k: int = 10) -> tuple[DataFrame, DataFrame]:
    """From files to (catalog pruned to what the cases hold, cases with their split)."""
    songs = first_wins(read_catalog(spark, catalog))
    if playlists.endswith(".csv"):
        tracks = read_playlist_csv(spark, playlists, songs, max_playlists or None)
    else:
        tracks = matched_playlists(read_playlists(spark, playlists), songs, max_playlists)
    cases = holdout(tracks.select("playlist_id", "pos", "song_id"), holdout_k, least, max_cases or None)
    return songs.join(cases.select("song_id").distinct(), "song_id", "left_semi"), cases


# The demonstration's items and playlists.
DEMO_SONGS = [
    ("Dancing Queen", "ABBA", "dance night young sweet music party"),
    ("Billie Jean", "Michael Jackson", "dance floor night beat"),
    ("Someone Like You", "Adele", "sad goodbye remember love"),
    ("Hello", "Adele", "hello from outside sorry heart"),
    ("Bad Romance", "Lady Gaga", "love romance dance party"),
    ("Poker Face", "Lady Gaga", "dance club love"),
    ("Let It Be", "The Beatles", "mother wisdom peace"),
    ("Hey Jude", "The Beatles", "sad song better heart"),
]
DEMO_PLAYLISTS = {"demo_pop": ("Dancing Queen", "Billie Jean", "Bad Romance", "Poker Face"), "demo_adele": ("Someone Like You", "Hello", "Hey Jude")}


def demo(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(songs, tracks) of the demonstration; its playlists are split with holdout_k = 1 and least = 3."""
    songs = spark.createDataFrame(DEMO_SONGS, "title string, artist string, lyrics string").select(song_key(F.col("title"), F.col("artist")).alias("song_id"), "title", "artist", "lyrics")
    rows = [(p, i, t) for p, titles in DEMO_PLAYLISTS.items() for i, t in enumerate(titles)]
    lists = spark.createDataFrame(rows, "playlist_id string, pos int, title string")
    return songs, lists.join(songs, "title").select("playlist_id", "pos", "song_id", "title", "artist")


def read_song_profiles(spark: SparkSession, path: str, songs: DataFrame) -> DataFrame:
    """Profiles of catalog songs from a CSV whose lists are divided by |."""
    raw = _csv(spark, path).join(songs.select("song_id"), "song_id", "left_semi")
    part = lambda k: F.filter(F.transform(F.split(F.coalesce(F.col(k), F.lit("")), r"\|"), F.trim), lambda x: x != "")
    return raw.select("song_id", *normalize_profile({k: part(k) if k in v.LIST_KEYS else F.col(k) for k in v.KEYS if k in raw.columns}))


def strict_lookup(keys: DataFrame, cache: DataFrame) -> DataFrame:
    """The cached profile of every key; reading it fails where one is missing."""
    have = cache.withColumn("_have", F.lit(True))
    rows = keys.join(have, "cache_key", "left")
    return rows.where(F.when(F.col("_have").isNull(), F.raise_error(F.concat(F.lit("no cached profile for "), F.col("cache_key"))).cast("boolean")).otherwise(True)).drop("_have")
