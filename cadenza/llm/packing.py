"""Hierarchical residual packing of documents into sequences of bounded length.

Each partition packs its pieces by best fit, longest first, and emits the bins that are nearly full.
What is left, the underfull bins, goes up a tree: a node takes the bins of FANOUT children as items and
packs them by best fit again, until one node is left.

How much goes up is bounded without loss. After best fit no two bins of a node fit into one, so at most
one of them is half empty or more. Every join at a higher node takes such a bin, so a node with FANOUT
children makes at most FANOUT joins, for which the FANOUT emptiest other bins of each child suffice as
hosts in one round, and FANOUT for each round above. All others are emitted as they are.

Defined results: a null or empty text is the one end token; an empty table gives no rows; repeated rows
are packed one by one; other columns are ignored; a text of any length is encoded and cut as a whole, so memory
is bounded by the longest one; of equal lengths the earlier piece is packed first. Any division into partitions gives a valid packing; the
leaves' result is written to the shared folder before the tree reads it, so that a lost executor can't mix
two different packings.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cadenza.llm.common import Scratch, text_batches, text_of, tidy
from cadenza.llm.token_counts import byte_letters

CAPACITY = 2048
END = 0
FANOUT = 16
#: A bin with no more room than this part of the capacity is nearly full.
SLACK = 64
#: Pieces that one leaf packs at a time: more would only cost memory.
LEAF = 100_000
#: Rounds that the hosts sent up are enough for: FANOUT ** ROUNDS leaves.
ROUNDS = 8


class Encoder:
    """Ids as the tokenizers library gives them for a byte-level .json. The same vocabulary and merges run
    in tiktoken, four times as fast; texts that it can't take go to the library itself."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in self.special}
        self.fast = tiktoken.Encoding("own", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens=self.special)
        self.path, self.slow = path, None

    def __call__(self, text: str) -> list[int]:
        try:
            if any(s in text for s in self.special):
                return self.fast.encode(text, allowed_special="all")
            return self.fast.encode_ordinary(text)
        except BaseException as e:  # the library's panics aren't Exceptions
            if type(e).__name__ not in ("PanicException", "ValueError"):
                raise
            self.slow = self.slow or Tokenizer.from_file(self.path)
            return self.slow.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than the capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """The bin and offset of each item, taken in order of falling length, and the fill of each bin. A bit
    set of the residuals in use finds the bin with the least room that is enough."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, fills = 0, []
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for i in order:
        n = lengths[i]
        if above := rooms >> n:
            room = n + (above & -above).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins, offsets, fills


def going_up(fills: list[int], capacity: int, rounds: int = ROUNDS) -> set[int]:
    """The bins of a node that can still take part in a join higher up."""
    slack = capacity // SLACK
    open_ = sorted((f, b) for b, f in enumerate(fills) if f < capacity - slack)
    small = [b for f, b in open_ if 2 * f <= capacity]
    hosts = [b for f, b in open_ if 2 * f > capacity][: FANOUT * rounds]
    return {*small, *hosts}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each document, packed within their partition: bin, offset, and whether the bin goes up.
    with_ids: also the ids, as packed little-endian unsigned 32-bit integers."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long, up boolean" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        base = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        made = 0

        def leaf() -> pa.RecordBatch:
            nonlocal made, rows
            bins, offsets, fills = best_fit([r[3] for r in rows], capacity)
            up = going_up(fills, capacity)
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array(c, t) for c, t in zip(cols[:5], (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            arrays += [pa.array([base + made + b for b in bins], pa.int64()), pa.array(offsets, pa.int64()), pa.array([fills[b] for b in bins], pa.int64()), pa.array([b in up for b in bins], pa.bool_())]
            made += len(fills)
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill", "up"]
            if with_ids:
                arrays.append(pa.array(cols[5], pa.binary()))
                names.append("ids")
            rows = []
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = np.array([*encode(text.as_py()), end], "<u4").tobytes()
                for k, (s, n) in enumerate(cuts(len(raw) // 4, capacity)):
                    own = raw[4 * s : 4 * (s + n)]
                    rows.append((doc, k, s, n, zlib.crc32(own), own if with_ids else None))
                if len(rows) >= LEAF:
                    yield leaf()
        if rows:
            yield leaf()
        rows = []
        encoder.cache_clear()  # the vocabulary takes more memory than its reading takes time

    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return text_batches(text).mapInArrow(tidy(run), schema)


def _node(capacity: int):
    def merge(node: pa.Table) -> pa.Table:
        """One node of the tree: the current bins are the items."""
        now = node["now"].to_pylist()
        items = sorted(dict(zip(now, node["fill"].to_pylist(), strict=True)).items())
        bins, offsets, fills = best_fit([n for _, n in items], capacity)
        up = going_up(fills, capacity)
        head = {b: name for (name, _), b, o in zip(items, bins, offsets, strict=True) if o == 0}
        to = {name: (head[b], o, fills[b], b in up) for (name, _), b, o in zip(items, bins, offsets, strict=True)}
        moved = [to[n] for n in now]
        return pa.table(
            {
                "bin": node["bin"],
                "now": pa.array([m[0] for m in moved], pa.int64()),
                "shift": pa.array([s + m[1] for s, m in zip(node["shift"].to_pylist(), moved, strict=True)], pa.int64()),
                "fill": pa.array([m[2] for m in moved], pa.int64()),
                "node": pa.array([n // FANOUT for n in node["node"].to_pylist()], pa.int64()),
                "up": pa.array([m[3] for m in moved], pa.bool_()),
            }
        )

    return merge


def tree_merge(leaves: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pack the underfull bins of the leaves round by round; bin -> the bin that holds it, and where."""
    spark = leaves.sparkSession
    schema = "bin long, now long, shift long, fill long, node long, up boolean"
    state = leaves.where("up and offset = 0").select("bin", F.col("bin").alias("now"), F.lit(0).cast("long").alias("shift"), "fill", F.shiftright("bin", 40).alias("node"), "up")
    top = state.agg(F.max("node")).first()[0]
    done = spark.createDataFrame([], schema)
    while top is not None:
        merged = state.groupBy((F.col("node") / FANOUT).cast("long").alias("group")).applyInArrow(_node(capacity), schema)
        done = done.unionByName(merged.where("not up"))
        state = merged.where("up")
        top = top // FANOUT if top >= FANOUT else None
    return done.unionByName(state).where("bin != now").select("bin", "now", "shift")


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Every piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    scratch = Scratch(spark, "packing")
    leaves = scratch.write(pieces(docs, tokenizer, capacity, end, with_ids))
    # only bins that were joined: at most one for each leaf and round
    moved = scratch.write(tree_merge(leaves, capacity))
    out = leaves.join(moved, "bin", "left")
    columns = [
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.coalesce("now", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    ]
    return out.select(*columns, *(["ids"] * with_ids))
