"""Token counts by merging byte pairs of whole batches at once.

A byte-level BPE vocabulary (a tokenizer .json) is read into arrays. The distinct pre-tokens of a batch
lie one after the other in one symbol array with offsets (a ragged array). In each round every sequence
applies its own lowest-ranked pair, everywhere in it, and all sequences do so in the same array
operations; sequences that have no pair left are counted and taken out.

Defined results: null or empty text has 0 bytes and 0 tokens; the special token of the vocabulary inside a
text counts as one token, as the library does by default; repeated rows are counted one by one; other
columns are ignored. Memory holds one Arrow batch, its distinct pre-tokens, and a bounded cache.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import text_batches, text_of

#: White space as Unicode has it (regex's own \s takes in some control characters).
_WS = r"\t-\r \x85\xa0  -     　"
#: How byte-level BPE cuts a text into pre-tokens (fixed by the vocabulary).
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
#: Distinct pre-tokens whose counts a Python worker remembers from batch to batch.
CACHE = 400_000
_NONE = np.int32(2**31 - 1)


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for the 256 bytes: printable ones stand for themselves,
    the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """The merge table of a byte-level BPE vocabulary, for lookups of many pairs at a time."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        letters = byte_letters()
        self.first = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.first[b] = vocab[letter]
        self.size = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        # an open hash table: most lookups end at the first slot
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, _NONE, np.int32)
        self.made = made
        rest, at, rank = keys, self.slot(keys), np.arange(len(keys), dtype=np.int32)
        while len(rest):
            free = self.key[at] < 0
            _, one = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            one = one[free[one]]
            self.key[at[one]], self.rank[at[one]] = rest[one], rank[one]
            left = np.ones(len(rest), bool)
            left[one] = False
            rest, rank, at = rest[left], rank[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, _NONE where it doesn't merge."""
        keys = left * self.size + right
        at = self.slot(keys)
        out = np.full(len(keys), _NONE, np.int32)
        todo = np.arange(len(keys))
        while len(todo):
            found = self.key[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.rank[at[hit]]
            more = ~hit & (found >= 0)
            todo, at = todo[more], (at[more] + 1) & ((1 << self.bits) - 1)
        return out

    def counts(self, pretokens: list[bytes]) -> np.ndarray:
        """The number of symbols that survive in each pre-token."""
        out = np.zeros(len(pretokens), np.int64)
        lengths = np.array([len(p) for p in pretokens], np.int64)
        who = np.flatnonzero(lengths > 0)
        lengths = lengths[who]
        symbols = self.first[np.frombuffer(b"".join(pretokens), np.uint8)]
        while len(who):
            starts = np.cumsum(lengths) - lengths
            seq = np.repeat(np.arange(len(who)), lengths)
            rank = np.full(len(symbols), _NONE, np.int32)
            inner = np.ones(len(symbols), bool)
            inner[starts + lengths - 1] = False
            at = np.flatnonzero(inner)
            rank[at] = self.ranks(symbols[at], symbols[at + 1])
            lowest = np.minimum.reduceat(rank, starts)
            live = lowest != _NONE
            out[who[~live]] = lengths[~live]
            take = (rank == lowest[seq]) & (rank != _NONE)
            # of pairs that overlap (a run of one letter) every second one merges, from the left
            before = np.zeros(len(take), bool)
            before[1:] = take[:-1]
            run = np.flatnonzero(take & ~before)
            if len(run) != int(take.sum()):
                pos = np.flatnonzero(take)
                since = pos - run[np.searchsorted(run, pos, side="right") - 1]
                take[pos[since % 2 == 1]] = False
            where = np.flatnonzero(take)
            symbols[where] = self.made[rank[where]]
            keep = live[seq]
            keep[where + 1] = False
            lengths = (lengths - np.bincount(seq[where], minlength=len(who)))[live]
            symbols, who = symbols[keep], who[live]
        return out


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


def count_texts(texts: list[str], table: Merges, known: dict[str, int]) -> list[int]:
    """Tokens of each text; `known` carries counts of pre-tokens from batch to batch."""
    find = regex.compile(PRETOKEN).findall
    special = regex.compile("|".join(map(regex.escape, sorted(table.special, key=len, reverse=True)))) if table.special else None
    parts, extra, owner = [], [0] * len(texts), []
    for i, t in enumerate(texts):
        pieces = [t]
        if special is not None and any(s in t for s in table.special):
            pieces = special.split(t)
            extra[i] = len(pieces) - 1
        for p in pieces:
            parts.append(find(p))
            owner.append(i)
    new = list(set().union(*parts) - known.keys())
    if len(known) + len(new) > CACHE:
        known.clear()
        new = list(set().union(*parts))
    # sorted by length, the arrays shrink fast; in blocks, memory stays bounded
    for lo in range(0, len(new), 200_000):
        block = new[lo : lo + 200_000]
        known.update(zip(block, table.counts([p.encode() for p in block]).tolist(), strict=True))
    of = known.__getitem__
    for i, p in zip(owner, parts, strict=True):
        extra[i] += sum(map(of, p))
    return extra


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row. `tokenizer`: a byte-level BPE .json, on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        known: dict[str, int] = {}
        table = merges(tokenizer)
        for batch in batches:
            step = 512
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                texts = part.column(1).to_pylist()
                n = count_texts(texts, table, known)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(t.encode()) for t in texts], pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array([x > limit for x in n], pa.bool_()),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return text_batches(rows).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
