"""Document fingerprints by consistent weighted sampling.

A document is a bag of words; a word's weight is how often it occurs. For each of SAMPLES independent
draws, every weighted word gets gamma-distributed variates from a hash of the word (r and c from
Gamma(2, 1), beta uniform); its weight is rounded down to a step of r, t = floor(ln w / r + beta), and the
word with the least a = c / exp(r (t - beta + 1)) is the sample. Two documents draw the same (word, step)
with a probability equal to their generalised Jaccard similarity, sum of minima over sum of maxima.

ln a is a continuous function of word and step, so the least ln a itself names the sample, and a draw is one
minimum: an aggregate with a fixed-width buffer. r decides whether two weights of one word give one step, so it is
exact: minus the logarithm of a product of two uniform variates. c decides which word wins, by its lower tail
when there are many; ln c is interpolated in a table of quantiles whose cells become finer towards 0 (a
logarithm costs this query as much as all else in a draw). r, c and beta take bits of their own.

Everything here is built from DataFrame functions. The texts are shuffled once, into ranges of doc_id;
a range gets the first document of the range that follows, so that each document meets its successor.

Defined results: null text is the empty text; it has no words, the fingerprint EMPTY in all places, and a
likeness of 1 to another text without words and of 0 to all others. Null ids come last in the order. Rows
with one id are in the order of their texts' hashes. A single row is its own successor; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import text_of, words_of

SAMPLES = 72
#: Draws that are made in one pass over the words.
LOT = 24
#: Documents in a range, on average, until there are MAX_RANGES of them.
RANGE_ROWS, MAX_RANGES = 1024, 1 << 16
#: Cells of the quantile table of ln c at each level; each level divides the first cell of the one before.
_CELL_BITS, _LEVELS = 8, 3
_CELLS = 1 << _CELL_BITS
EMPTY = 0xFFFF


def gamma_quantiles(at: np.ndarray) -> np.ndarray:
    """Quantiles of Gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x), by bisection."""
    low, high = np.zeros(len(at)), np.full(len(at), 60.0)
    for _ in range(200):
        mid = (low + high) / 2
        # for small x the series keeps the digits that 1 - (1 + x) exp(-x) loses
        value = np.where(mid < 1e-3, mid**2 / 2 - mid**3 / 3, -np.expm1(-mid) - mid * np.exp(-mid))
        below = value < at
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def _table() -> np.ndarray:
    """ln c at the cells' lower ends, level by level, then the steps to their upper ends."""
    low, high = [], []
    for k in range(_LEVELS):
        # the last level's first cell begins at a quarter of its width, as ln 0 has no value
        edge = np.clip(np.arange(_CELLS + 1) / _CELLS, 1 / (4 * _CELLS), 1 - 1e-5) / float(_CELLS) ** k
        at = np.log(gamma_quantiles(edge))
        low.append(at[:-1])
        high.append(at[1:])
    return np.round(np.concatenate([*low, *(h - x for h, x in zip(high, low, strict=True))]), 6)


def sample_exprs(term: Column, log_weight: Column, samples: int) -> list[Column]:
    """ln a of a weighted word in each of `samples` draws; null where the weight is."""
    table = _numbers(_table().tolist(), "double")
    out = []
    for k in range(samples):
        x = F.xxhash64(term.bitwiseXOR(F.lit(k * 0x9E3779B97F4A7C15 % (1 << 63))))
        bits = lambda at, n, x=x: F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << n) - 1))
        level = [bits(_CELL_BITS * i, _CELL_BITS).cast("int") for i in range(_LEVELS)]
        at = level[-1] + F.lit(_CELLS * (_LEVELS - 1))
        for i in range(_LEVELS - 2, -1, -1):
            at = F.when(level[i] > 0, level[i] + F.lit(_CELLS * i)).otherwise(at)
        inside, beta = bits(24, 16) / F.lit(float(1 << 16)), bits(40, 24) / F.lit(float(1 << 24))
        ln_c = F.get(table, at) + inside * F.get(table, at + F.lit(_CELLS * _LEVELS))
        y = F.xxhash64(x)
        u, v = F.shiftrightunsigned(y, 32) + F.lit(0.5), y.bitwiseAND(F.lit((1 << 32) - 1)) + F.lit(0.5)
        r = F.lit(64 * math.log(2)) - F.ln(u * v)
        out.append(ln_c - r * (F.floor(log_weight / r + beta) + F.lit(1.0) - beta))
    return out


def weighted_words(text: Column) -> Column:
    """Hashes of the words of a text, in order; weights are the lengths of their runs."""
    return F.sort_array(F.transform(words_of(text), lambda w: F.xxhash64(w)))


def runs_of(hashes: Column, starts: Column) -> Column:
    """(term, weight) for each run of equal hashes."""
    return F.transform(
        starts,
        lambda s, j: F.struct(F.get(hashes, s).alias("term"), (F.coalesce(F.get(starts, j + 1), F.size(hashes)) - s).alias("weight")),
    )


def _numbers(values: list, kind: str) -> Column:
    """An array literal of few nodes: Spark folds the text into one constant."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _range_of(key: Column, splits: list[int]) -> Column:
    """The number of splits that are greater than the key: ranges from the largest keys (0) down. `splits`
    fall; the steps of a binary search are folded over, so the plan doesn't grow with their number."""
    if not splits:
        return F.lit(0)
    steps = [1 << b for b in range(len(splits).bit_length() - 1, -1, -1)]
    table = _numbers(splits, "long")
    reach = lambda found, step: F.coalesce(F.get(table, found + step - 1) > key, F.lit(False))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda found, step: F.when(reach(found, step), found + step).otherwise(found))


def with_successor(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n_chars and next_text of every row, in ranges; and `guest` rows, which stand at the end
    of a range and belong to the next one."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    src = src.withColumn("ord", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("digest", F.xxhash64("text"))
    n = src.count()
    ranges = max(1, min(MAX_RANGES, -(-n // RANGE_ROWS)))
    splits: list[int] = []
    if ranges > 1:
        at = [i / ranges for i in range(1, ranges)]
        found = src.agg(F.percentile_approx("ord", at, 20 * ranges + 10_000).alias("q")).first().q
        splits = sorted(set(found), reverse=True)
    src = src.withColumn("range", _range_of(F.col("ord"), splits))
    # a row for each range: its first document
    first = src.groupBy("range").agg(F.min(F.struct((-F.col("ord").cast("decimal(20,0)")).alias("minus"), F.col("digest"))).alias("first"))
    heads = first.select("range", (-F.col("first")["minus"]).cast("long").alias("ord"), F.col("first")["digest"].alias("digest")).collect()
    order = sorted(r["range"] for r in heads)
    goes_to = {r: order[i - 1] for i, r in enumerate(order)}
    spark = docs.sparkSession
    guests = spark.createDataFrame([(h["range"], h["ord"], h["digest"], goes_to[h["range"]]) for h in heads], "range int, ord long, digest long, to int")
    # equal rows may stand for one head; one of them is enough
    guest_rows = (
        src.join(F.broadcast(guests), ["range", "ord", "digest"])
        .groupBy("range", "to", "ord", "digest", "doc_id")
        .agg(F.first("text").alias("text"))
        .select("doc_id", "text", "ord", "digest", F.col("to").alias("range"), F.lit(True).alias("guest"))
    )
    both = src.withColumn("guest", F.lit(False)).unionByName(guest_rows)
    w = Window.partitionBy("range").orderBy("guest", F.desc("ord"), "digest")
    return both.withColumn("place", F.row_number().over(w)).withColumn("next_text", F.lead("text").over(w))


def signatures(rows: DataFrame, keys: list[str], text: str, samples: int = SAMPLES) -> DataFrame:
    """The draws of each row's text, as an array `drawn` of `samples` 16-bit names; `keys` tell rows apart."""
    hashes, starts = F.col("_h"), F.col("_s")
    terms = (
        rows.select(*keys, weighted_words(F.col(text)).alias("_h"))
        .select(*keys, "_h", F.filter(F.sequence(F.lit(0), F.greatest(F.size(hashes), F.lit(1)) - 1), lambda i: (i == 0) | (F.get(hashes, i) != F.get(hashes, i - 1))).alias("_s"))
        # the outer form: for the inner one Spark would test the array first, and compute it a second time
        .select(*keys, F.explode_outer(runs_of(hashes, starts)).alias("_r"))
        .select(*keys, F.col("_r")["term"].alias("term"), F.log(F.greatest(F.col("_r")["weight"], F.lit(1))).alias("log_weight"))
    )
    # draws are made in lots: so many minima in one aggregate run as compiled code, twice as many don't
    lots = -(-samples // LOT)
    size = -(-samples // lots)
    terms = terms.select(*keys, "term", "log_weight", F.explode(F.array(*map(F.lit, range(lots)))).alias("_lot"))
    terms = terms.select(*keys, F.xxhash64("term", "_lot").alias("term"), "log_weight", "_lot")
    draws = sample_exprs(F.col("term"), F.col("log_weight"), size)
    least = terms.groupBy(*keys, "_lot").agg(*(F.min(d).alias(f"_m{k}") for k, d in enumerate(draws)))
    names = F.array(
        *(
            F.when(F.col(f"_m{k}").isNull(), F.lit(EMPTY)).otherwise(F.pmod(F.xxhash64(f"_m{k}"), F.lit(EMPTY))).cast("int")
            for k in range(size)
        )
    )
    by_lot = least.select(*keys, F.struct("_lot", names.alias("names")).alias("_d"))
    drawn = F.flatten(F.transform(F.sort_array(F.collect_list("_d")), lambda d: d["names"]))
    return by_lot.groupBy(*keys).agg(drawn.alias("drawn"))


def likeness(a: Column, b: Column) -> Column:
    """The share of draws that two signatures have in common."""
    same = F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)
    return F.size(same) / F.greatest(F.size(a), F.lit(1))


def as_text(drawn: Column) -> Column:
    return F.lower(F.array_join(F.transform(drawn, lambda x: F.lpad(F.hex(x), 4, "0")), ""))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """doc_id and the fingerprint of each row's text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), F.monotonically_increasing_id().alias("_row"))
    return signatures(rows, ["doc_id", "_row"], "text", samples).select("doc_id", as_text(F.col("drawn")).alias("fingerprint"))


def fingerprint_edits(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited text: its second half replaced by the start of the
    next document, in the order of falling ids (after the last one, the first)."""
    rows = with_successor(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    own = F.struct(F.lit(0).alias("role"), F.col("text").alias("text"))
    changed = F.struct(F.lit(1).alias("role"), edited.alias("text"))
    roles = rows.select(
        "range",
        "place",
        "guest",
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.explode(F.when(F.col("guest"), F.array(own)).otherwise(F.array(own, changed))).alias("x"),
    ).select("range", "place", "guest", "doc_id", "n_chars", "x.role", "x.text")
    roles = roles.withColumn("sha", F.when(F.col("role") == 1, F.unhex(F.sha2(F.encode("text", "utf-8"), 256))))
    # all keys begin with the range, by which the rows lie together already: no further shuffle
    drawn = signatures(roles, ["range", "place", "guest", "doc_id", "n_chars", "role", "sha"], "text", samples)
    pair = drawn.groupBy("range", "place", "guest", "doc_id", "n_chars").agg(
        F.max(F.when(F.col("role") == 0, F.col("drawn"))).alias("own"),
        F.max(F.when(F.col("role") == 1, F.col("drawn"))).alias("edited"),
        F.max("sha").alias("sha"),
    )
    after = F.lead("own").over(Window.partitionBy("range").orderBy("place"))
    return (
        pair.withColumn("after", after)
        .where(~F.col("guest"))
        .select(
            "doc_id",
            "n_chars",
            F.lower(F.hex("sha")).alias("edited_sha256"),
            as_text(F.col("own")).alias("fingerprint"),
            as_text(F.col("edited")).alias("edited_fingerprint"),
            likeness(F.col("own"), F.col("edited")).alias("near_edited"),
            likeness(F.col("own"), F.col("after")).alias("near_next"),
        )
    )
