"""Candidate pools: collaborative filtering, same artist, content and popularity, merged in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.cf import DIGITS
from cadenza.operators.split import numbered, recent

# Pool sizes and shares of the same artist.
POOLS = (100, 200, 300, 400, 500)
RATIOS = (0.25, 0.5, 0.75, 1.0)


def quota(pool: int, ratio: float) -> int:
    """Half-even rounding of pool * ratio, within the pool."""
    return max(0, min(pool, round(pool * ratio)))


def ordered(scores: DataFrame, pop: DataFrame, score: str) -> DataFrame:
    """Scores by (score, popularity) falling, then song_id: case_idx, song_id, rank."""
    with_pop = scores.join(pop.select("song_id", "pop"), "song_id", "left")
    order = Window.partitionBy("case_idx").orderBy(F.round(score, DIGITS).desc(), F.coalesce("pop", F.lit(0)).desc(), "song_id")
    return with_pop.withColumn("rank", F.row_number().over(order)).select("case_idx", "song_id", "rank")


def popular_unseen(split: DataFrame, top: DataFrame) -> DataFrame:
    """For each case the popular items that it hasn't observed, in their order. The popular list is short by
    definition (its limit bounds it), so it is broadcast to the cases."""
    cases = split.select("case_idx").distinct()
    seen = split.where("observed").select("case_idx", "song_id")
    rows = cases.join(F.broadcast(top.select("song_id", "pop_rank"))).join(seen, ["case_idx", "song_id"], "left_anti")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("case_idx").orderBy("pop_rank"))).select("case_idx", "song_id", "rank")


def merge(routes: list[DataFrame], interleave: int, pool: int) -> DataFrame:
    """Candidate lists into one order: the first `interleave` lists in turn, then the others one after the
    other; the first place of an item counts. case_idx, song_id, place (up to `pool`)."""
    rows = None
    for no, r in enumerate(routes):
        turn = no < interleave
        own = r.select("case_idx", "song_id", F.struct(F.lit(0 if turn else no + 1).alias("part"), F.col("rank").alias("rank"), F.lit(no).alias("no")).alias("at"))
        rows = own if rows is None else rows.unionByName(own)
    first = rows.groupBy("case_idx", "song_id").agg(F.min("at").alias("at"))
    place = F.row_number().over(Window.partitionBy("case_idx").orderBy("at"))
    return first.withColumn("place", place).where(F.col("place") <= pool).select("case_idx", "song_id", "place")


def artist_candidates(split: DataFrame, songs: DataFrame, pop: DataFrame, window: int = 10, top: int = 500) -> DataFrame:
    """Unobserved items of the artists that a case observed: recent ones count 1000 each, all 200 each,
    popularity a thousandth. case_idx, song_id, score, rank."""
    art = songs.select("song_id", "artist")
    everywhere = split.where("observed").join(art, "song_id").groupBy("case_idx", "artist").agg(F.count("*").alias("n_all"))
    lately = recent(split, window).join(art, "song_id").groupBy("case_idx", "artist").agg(F.count("*").alias("n_recent"))
    counts = everywhere.join(lately, ["case_idx", "artist"], "left")
    seen = split.where("observed").select("case_idx", "song_id")
    # of an artist's items, which a case orders by popularity alone, only so many can be among its first `top`
    longest = split.where("observed").groupBy("case_idx").agg(F.count("*").alias("n")).agg(F.max("n").alias("longest"))
    place = F.row_number().over(Window.partitionBy("artist").orderBy(F.coalesce("pop", F.lit(0)).desc(), "song_id"))
    best = art.join(pop.select("song_id", "pop"), "song_id", "left").withColumn("place", place)
    best = best.join(F.broadcast(longest)).where(F.col("place") <= top + F.col("longest")).select("artist", "song_id", "pop")  # one row
    rows = counts.join(best, "artist").join(seen, ["case_idx", "song_id"], "left_anti")
    score = 1000.0 * F.coalesce("n_recent", F.lit(0)) + 200.0 * F.col("n_all") + 0.001 * F.coalesce("pop", F.lit(0))
    order = Window.partitionBy("case_idx").orderBy(F.round("score", DIGITS).desc(), F.coalesce("pop", F.lit(0)).desc(), "song_id")
    return rows.withColumn("score", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("case_idx", "song_id", "score", "rank")


def cf_pop_pool(cf: DataFrame, pop: DataFrame, unseen: DataFrame, pool: int = 500) -> DataFrame:
    """Collaborative filtering first, filled up with what is popular."""
    return merge([ordered(cf, pop, "cf"), unseen], 0, pool)


def forced_pool(artist: DataFrame, base: DataFrame, pool: int = 500, ratio: float = 0.25) -> DataFrame:
    """The artist's quota first, then the base pool of the same size."""
    forced = artist.where(F.col("rank") <= quota(pool, ratio))
    rest = base.where(F.col("place") <= pool).select("case_idx", "song_id", F.col("place").alias("rank"))
    return merge([forced, rest], 0, pool)


def recall_of(pools: DataFrame, split: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Mean share of the held-out items found, by `keys`; order within a pool doesn't matter."""
    truth = split.where("not observed").select("case_idx", "song_id")
    sizes = truth.groupBy("case_idx").agg(F.count("*").alias("n_true"))
    cases = sizes.agg(F.count("*").alias("n_cases"))
    hits = pools.join(truth, ["case_idx", "song_id"], "left_semi").groupBy(*keys, "case_idx").agg(F.count("*").alias("hits"))
    # cases without a hit add nothing to the sum but count in the mean
    total = hits.join(sizes, "case_idx").groupBy(*keys).agg(F.sum(F.col("hits") / F.col("n_true")).alias("s"))
    return total.join(F.broadcast(cases)).select(*keys, F.round(F.col("s") / F.col("n_cases"), 6).alias("recall"))


def recall_grid(split: DataFrame, cf: DataFrame, artist: DataFrame, base: DataFrame, pop: DataFrame, unseen: DataFrame) -> DataFrame:
    """Recall by method and pool size. Pools aren't made: an item's place in each of them follows from its
    rank in the two lists, and only the held-out items' places are needed.

    The quota's items come first; an item of the base list with place b is then the (b - f)th of the others,
    where f counts the quota's items before it."""
    combos = [(r, p, quota(p, r)) for r in RATIOS for p in POOLS]
    quotas = sorted({q for _, _, q in combos})
    both = artist.select("case_idx", "song_id", F.col("rank").alias("a"), F.lit(None).cast("int").alias("b")).unionByName(
        base.select("case_idx", "song_id", F.lit(None).cast("int").alias("a"), F.col("place").alias("b"))
    )
    items = both.groupBy("case_idx", "song_id").agg(F.min("a").alias("a"), F.min("b").alias("b"))
    before = Window.partitionBy("case_idx").orderBy(F.col("b").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    counts = F.array(*(F.struct(F.lit(q).alias("q"), F.coalesce(F.count_if((F.col("a") <= q) & F.col("b").isNotNull()).over(before), F.lit(0)).alias("f")) for q in quotas))
    placed = items.select("case_idx", "song_id", "a", "b", counts.alias("counts"), F.max("a").over(Window.partitionBy("case_idx")).alias("n_artist"))
    found = placed.join(split.where("not observed").select("case_idx", "song_id"), ["case_idx", "song_id"], "left_semi")
    table = F.array(*(F.struct(F.lit(f"CF + artist{int(r * 100)}% + popularity").alias("method"), F.lit(p).alias("pool"), F.lit(q).alias("q"), F.lit(quotas.index(q)).alias("no")) for r, p, q in combos))
    each = found.withColumn("x", F.explode(table)).withColumn("f", F.get("counts", F.col("x.no"))["f"])
    forced = F.coalesce(F.col("a") <= F.col("x.q"), F.lit(False))
    others = (F.col("b") <= F.col("x.pool")) & (F.least(F.coalesce("n_artist", F.lit(0)), "x.q") + F.col("b") - F.col("f") <= F.col("x.pool"))
    all_ = each.where(forced | F.coalesce(others, F.lit(False))).select("x.method", "x.pool", "case_idx", "song_id")
    sizes = F.explode(F.array(*map(F.lit, POOLS))).alias("pool")
    truth = split.where("not observed").select("case_idx", "song_id")
    for name, ranked in (("Popularity", unseen), ("CF", ordered(cf, pop, "cf"))):
        hit = ranked.join(truth, ["case_idx", "song_id"], "left_semi").select(F.lit(name).alias("method"), sizes, "case_idx", "song_id", "rank").where("rank <= pool")
        all_ = all_.unionByName(hit.drop("rank"))
    return recall_of(all_, split, ("method", "pool"))


def md5_order(seed: int, *parts: Column) -> Column:
    """A seeded order that any engine reproduces."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts)))


def random_catalog(split: DataFrame, songs: DataFrame, seed: int, top: int) -> DataFrame:
    """case_idx, song_id, rank: the first `top` unobserved items of the catalog in a seeded order for each case.

    The catalog has one seeded order, in which every case begins at a seeded place of its own and goes round: so a
    case meets as many items as it observed and `top` more, not the catalog."""
    order = numbered(songs.select("song_id", md5_order(seed, F.col("song_id")).alias("o")).orderBy("o", "song_id"))
    order = order.select("song_id", F.col("case_idx").alias("place"))
    n = order.count()
    seen = split.where("observed").select("case_idx", "song_id")
    cases = split.groupBy("case_idx").agg(F.count_if("observed").alias("n_seen"))
    start = F.conv(F.substring(md5_order(seed, F.lit("start"), F.col("case_idx")), 1, 8), 16, 10).cast("long")
    steps = F.sequence(F.lit(0).cast("long"), F.least(F.col("n_seen") + top, F.lit(max(n, 1))).cast("long") - 1)
    walk = cases.select("case_idx", start.alias("start"), F.explode(steps).alias("step"))
    rows = walk.withColumn("place", (F.pmod(F.col("start") + F.col("step"), F.lit(max(n, 1))) + 1).cast("int")).join(order, "place").join(seen, ["case_idx", "song_id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("case_idx").orderBy("step"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top).select("case_idx", "song_id", "rank")
