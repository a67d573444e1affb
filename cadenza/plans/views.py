"""The fixture: items, playlists and their tracks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions import vocabulary as v
from cadenza.functions.text import song_key
from cadenza.operators.catalog import usable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), "p_type", song_key(F.col("p_name"), F.col("p_brand")).alias("song_id")
    )


def catalog_rows(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Rows of the item catalog with their place in the file: ord, song_id, title, artist, lyrics. With `only` (ord, few
    rows) those alone, of which just the texts go through the join."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("lyrics"))
    items = parts(spark, sf_dir)
    if only is not None:
        docs = docs.join(F.broadcast(only.withColumnRenamed("ord", "doc_id")), "doc_id", "left_semi")
        items = items.join(F.broadcast(only.withColumnRenamed("ord", "p_partkey")), "p_partkey", "left_semi")
    return items.join(docs, F.col("p_partkey") == F.col("doc_id")).select(F.col("p_partkey").alias("ord"), "song_id", "title", "artist", "lyrics")


def tasks(lines: DataFrame) -> int:
    """Partitions of about half a million lines, so that a task's share doesn't grow with the table."""
    return max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // 500_000))


def _in_order(spark: SparkSession, sf_dir: str, items: DataFrame) -> DataFrame:
    """The lines that have an order and an item (p_partkey): playlist_id, pos (from 1), the item's other columns. The rows
    of a playlist are in one partition."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    n = tasks(lines)
    rows = lines.repartition(n, "l_partkey").join(items, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")
    rows = rows.repartition(n, "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "l_orderkey", "l_linenumber", "l_partkey")
    columns = [c for c in items.columns if c != "p_partkey"]
    return rows.repartition(n, "o_custkey").select(F.col("o_custkey").alias("playlist_id"), F.row_number().over(order).alias("pos"), *columns)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every track of every playlist: playlist_id, pos (from 1), song_id, title, artist, p_type."""
    return _in_order(spark, sf_dir, parts(spark, sf_dir)).select("playlist_id", "pos", "song_id", "title", "artist", "p_type")


def song_tracks(spark: SparkSession, sf_dir: str, numbers: DataFrame) -> DataFrame:
    """playlist_id, pos (in their order), sid: the tracks whose song `numbers` (song_id, sid; few rows) has. No text is
    carried through the joins."""
    keys = parts(spark, sf_dir).join(F.broadcast(numbers), "song_id").select("p_partkey", "sid")
    return _in_order(spark, sf_dir, keys).where("playlist_id is not null")


def lexicon() -> list[str]:
    """Every word of the vocabulary's lists, once, in their order."""
    lists = (v.EXPANSIONS, v.GENRE_WORDS, v.AFFECT_WORDS, v.THEME_WORDS, v.CONTEXT_WORDS)
    return list(dict.fromkeys(w for table_ in lists for words in table_.values() for w in words))


def worded(songs: DataFrame, rows: DataFrame, words: int = 12) -> DataFrame:
    """Songs with lyrics out of the lexicon, picked by arithmetic on the key of their first row: the
    generated documents hold none of its words."""
    lex = lexicon()
    first = usable(rows).groupBy("song_id").agg(F.min("ord").alias("k"))
    pick = F.transform(
        F.sequence(F.lit(0), F.lit(words - 1)),
        lambda j: F.get(F.array(*map(F.lit, lex)), ((F.col("k") * 7 + j * (F.col("k") % 13 + 3)) % len(lex)).cast("int")),
    )
    return songs.join(first, "song_id").select("song_id", "title", "artist", F.array_join(pick, " ").alias("lyrics"))
