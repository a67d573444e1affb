"""The stages of the recommender, case by case: a case's items are numbers into a catalog that every task holds, so
that candidates, scores and ranks of a case are made at once, in arrays, and only what is asked for leaves the task.

No row is shuffled for a pair of case and item. It takes a catalog of at most `ITEMS` items; beyond that the
operators of the other modules, which join, do the same. Results are theirs: scores are compared after rounding to
nine places, equal ones as they say."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.adapter import KAR_PRODUCTS, SCALARS
from cadenza.operators.candidates import POOLS, RATIOS, quota

#: Items of a catalog that a task holds (with their neighbours or a matrix of their likeness), cells of a matrix of cases
#: and items, and the most cases in it.
ITEMS, CELLS, CASES = 2048, 1 << 18, 256
#: Items of the cases in a matrix (beyond that it holds one case), and pairs that are counted at a time.
HELD, PAIRS = 8192, 1 << 22
#: Places to which scores are rounded before they are compared.
SCALE = 1e9


@dataclass
class Catalog:
    """What is known of the items, by their number (their place in the order of ids)."""

    ids: list[str]
    present: np.ndarray  # whether a case holds the item
    pop: np.ndarray
    artist: np.ndarray  # numbers of artists
    top: np.ndarray  # the popular items in their order
    near: np.ndarray | None = None  # neighbours by rank, len(ids) where there is none
    weight: np.ndarray | None = None
    emotion: np.ndarray | None = None  # unit vectors
    kar: np.ndarray | None = None
    like: np.ndarray | None = None  # dot products of the items' texts
    votes: np.ndarray | None = None

    @cached_property
    def names(self) -> pa.Array:
        return pa.array(self.ids, pa.string())

    @cached_property
    def by_pop(self) -> np.ndarray:
        """Places of the items by falling popularity, then by id."""
        place = np.empty(len(self.ids), np.int64)
        place[np.lexsort((np.arange(len(self.ids)), -self.pop))] = np.arange(len(self.ids))
        return place


def rounded(x: np.ndarray) -> np.ndarray:
    """Scores as whole numbers of the last place that counts."""
    return np.floor(np.abs(x) * SCALE + 0.5).astype(np.int64) * np.sign(x).astype(np.int64)


def best(key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the places of the largest keys, in falling order, and how many there are; keys below 0 don't count,
    others are distinct."""
    most = min(most, key.shape[1])
    if most < key.shape[1]:
        at = np.argpartition(-key, most - 1, axis=1)[:, :most]
    else:
        at = np.broadcast_to(np.arange(key.shape[1]), key.shape)
    found = np.take_along_axis(key, at, 1)
    order = np.argsort(-found, axis=1)
    return np.take_along_axis(at, order, 1), (found >= 0).sum(axis=1)


def packed(items: np.ndarray, kept: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the kept items in their order, at most `most`, and how many there are."""
    place = np.cumsum(kept, axis=1) - 1
    kept = kept & (place < most)
    out = np.zeros((len(items), most), np.int64)
    r, c = np.nonzero(kept)
    out[r, place[r, c]] = items[r, c]
    return out, kept.sum(axis=1)


def min_max(x: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """To 0..1 over the valid cells of a row; if all are equal, 1 where they are positive."""
    low = np.where(valid, x, np.inf).min(axis=1, keepdims=True, initial=np.inf)
    high = np.where(valid, x, -np.inf).max(axis=1, keepdims=True, initial=-np.inf)
    flat = ~(high > low)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(flat, (x > 0).astype(float), (x - low) / np.where(flat, 1.0, high - low))


class Block:
    """Some cases: `seen` and `held` are items in their order, one case after the other, with the row they are of."""

    def __init__(self, catalog: Catalog, batch: pa.RecordBatch):
        self.catalog, self.size = catalog, len(catalog.ids)
        self.case = batch.column("case_idx").to_numpy()
        self.lists = batch.column("playlist_id")
        self.rows = len(self.case)
        songs = batch.column("songs")
        items, n = songs.flatten().to_numpy().astype(np.int64), np.diff(songs.offsets.to_numpy())
        self.n, self.n_seen = n, batch.column("n_seen").to_numpy().astype(np.int64)
        row = np.repeat(np.arange(self.rows), n)
        rn = np.arange(len(items)) - np.repeat(np.cumsum(n) - n, n)
        early = rn < self.n_seen[row]
        self.items, self.row, self.rn, self.observed = items, row, rn + 1, early
        self.seen, self.seen_row, self.seen_rn = items[early], row[early], rn[early] + 1
        self.held, self.held_row = items[~early], row[~early]
        self.n_true = n - self.n_seen
        self.vec, self.draws, self.is_train = (batch.column(c) if c in batch.schema.names else None for c in ("vec", "draws", "is_train"))

    def mask(self, rows: np.ndarray, items: np.ndarray) -> np.ndarray:
        out = np.zeros((self.rows, self.size), bool)
        out[rows, items] = True
        return out

    @cached_property
    def is_seen(self) -> np.ndarray:
        return self.mask(self.seen_row, self.seen)

    @cached_property
    def is_held(self) -> np.ndarray:
        return self.mask(self.held_row, self.held)

    def recent(self, window: int) -> np.ndarray:
        """Which of `seen` are among a case's last `window`."""
        return self.seen_rn > self.n_seen[self.seen_row] - window

    # ---- routes: (items, how many), best first

    @cached_property
    def cf(self) -> tuple[np.ndarray, np.ndarray]:
        """The 500 best by collaborative filtering, equal ones by what reached them first."""
        c, width = self.catalog, self.size + 1
        code = (self.seen_row[:, None] * width + c.near[self.seen]).ravel()
        scores = np.bincount(code, c.weight[self.seen].ravel(), self.rows * width).reshape(self.rows, width)[:, :-1]
        reach = c.near.shape[1]
        first = np.full(self.rows * width, -1, np.int64)
        first[code[::-1]] = ((self.seen_rn[:, None] - 1) * reach + np.arange(reach)).ravel()[::-1]
        first = first.reshape(self.rows, width)[:, :-1]
        self.cf_scores = scores
        valid = (first >= 0) & ~self.is_seen
        key, last = rounded(scores), int(first.max(initial=0)) + 1
        if key.max(initial=0) < (1 << 62) // last:
            return best(np.where(valid, key * last + (last - 1 - first), -1), 500)
        order = np.lexsort((first, -np.where(valid, key, -1)))[:, :500]
        return order, np.minimum(valid.sum(axis=1), 500)

    @cached_property
    def in_cf(self) -> np.ndarray:
        at, n = self.cf
        out = np.zeros((self.rows, self.size), bool)
        np.put_along_axis(out, at, np.arange(at.shape[1])[None, :] < n[:, None], 1)
        return out

    @cached_property
    def cf_ordered(self) -> tuple[np.ndarray, np.ndarray]:
        """The same by score, then popularity, then id."""
        at, n = self.cf
        valid = np.arange(at.shape[1])[None, :] < n[:, None]
        key = np.where(valid, rounded(np.take_along_axis(self.cf_scores, at, 1)), -1)
        return np.take_along_axis(at, np.lexsort((self.catalog.by_pop[at], -key)), 1), n

    @cached_property
    def unseen(self) -> tuple[np.ndarray, np.ndarray]:
        """The popular items that a case hasn't observed."""
        top = np.broadcast_to(self.catalog.top, (self.rows, len(self.catalog.top)))
        return packed(top, ~self.is_seen[:, self.catalog.top], max(1, len(self.catalog.top)))

    def filled(self, first: tuple[np.ndarray, np.ndarray], pool: int = 500) -> tuple[np.ndarray, np.ndarray]:
        """A list filled up with what is popular."""
        at, n = first
        valid = np.arange(at.shape[1])[None, :] < n[:, None]
        have = np.zeros((self.rows, self.size), bool)
        np.put_along_axis(have, at, valid, 1)
        more, k = self.unseen
        new = (np.arange(more.shape[1])[None, :] < k[:, None]) & ~np.take_along_axis(have, more, 1)
        return packed(np.hstack([at, more]), np.hstack([valid, new]), pool)

    @cached_property
    def base(self) -> tuple[np.ndarray, np.ndarray]:
        return self.filled(self.cf_ordered)

    @cached_property
    def by_artist(self) -> np.ndarray:
        """Observed items of each artist."""
        n = int(self.catalog.artist.max(initial=0)) + 1
        return np.bincount(self.seen_row * n + self.catalog.artist[self.seen], minlength=self.rows * n).reshape(self.rows, n)

    @cached_property
    def artist(self) -> tuple[np.ndarray, np.ndarray]:
        """The 500 best items of observed artists: recent ones count 1000 each, all 200 each, popularity a thousandth."""
        c, (_, n) = self.catalog, self.by_artist.shape
        late = self.recent(10)
        lately = np.bincount(self.seen_row[late] * n + c.artist[self.seen[late]], minlength=self.rows * n).reshape(self.rows, n)
        self.lately = lately
        score = (1_000_000 * lately + 200_000 * self.by_artist)[:, c.artist] + c.pop
        valid = (self.by_artist[:, c.artist] > 0) & c.present & ~self.is_seen
        return best(np.where(valid, score * self.size + (self.size - 1 - c.by_pop), -1), 500)

    @cached_property
    def artist_scores(self) -> np.ndarray:
        at, c = self.artist[0], self.catalog
        take = lambda x: np.take_along_axis(x, c.artist[at], 1)
        return 1000.0 * take(self.lately) + 200.0 * take(self.by_artist) + 0.001 * c.pop[at]

    @cached_property
    def pool(self) -> tuple[np.ndarray, np.ndarray]:
        """The artist's quota, then the base list."""
        at, n = self.artist
        forced = min(at.shape[1], quota(500, 0.25))
        at, valid = at[:, :forced], np.arange(forced)[None, :] < n[:, None]
        have = np.zeros((self.rows, self.size), bool)
        np.put_along_axis(have, at, valid, 1)
        rest, k = self.base
        new = (np.arange(rest.shape[1])[None, :] < k[:, None]) & ~np.take_along_axis(have, rest, 1)
        return packed(np.hstack([at, rest]), np.hstack([valid, new]), 500)

    # ---- scores of candidates

    def take(self, pool: tuple[np.ndarray, np.ndarray], name: str) -> np.ndarray:
        at = pool[0]
        if name == "cf":
            self.cf  # noqa: B018  makes the scores
            return np.where(np.take_along_axis(self.in_cf, at, 1), np.take_along_axis(self.cf_scores, at, 1), 0.0)
        if name == "artist":
            return np.take_along_axis(self.by_artist, self.catalog.artist[at], 1).astype(float)
        if name == "pop":
            return self.catalog.pop[at].astype(float)
        if name == "lemon":
            return np.take_along_axis(self.users @ self.catalog.emotion.T, at, 1)
        return np.take_along_axis(self.kar_users @ self.catalog.kar.T, at, 1)

    def norm(self, pool: tuple[np.ndarray, np.ndarray], name: str) -> np.ndarray:
        return min_max(self.take(pool, name), np.arange(pool[0].shape[1])[None, :] < pool[1][:, None])

    @cached_property
    def norms(self) -> dict[str, np.ndarray]:
        """Of the pool's candidates."""
        names = ["cf", "artist", "pop", *(["lemon"] if self.catalog.emotion is not None else []), *(["kar"] if self.catalog.kar is not None else [])]
        return {n: self.norm(self.pool, n) for n in names}

    @cached_property
    def users(self) -> np.ndarray:
        """Taste in emotions: long and short, blended by how far they are apart."""
        vec = self.catalog.emotion

        def unit(x: np.ndarray) -> np.ndarray:
            n = np.sqrt((x * x).sum(axis=1, keepdims=True))
            return np.where(n > 0, x / np.where(n > 0, n, 1.0), 0.0)

        def mean(which: np.ndarray) -> np.ndarray:
            counts = np.zeros((self.rows, self.size))
            counts[self.seen_row[which], self.seen[which]] = 1.0
            return unit(counts @ vec)

        long_, short = mean(np.ones(len(self.seen), bool)), mean(self.recent(8))
        cos = (long_ * short).sum(axis=1, keepdims=True)
        alpha = np.clip(0.35 + 0.35 * (1 - np.clip(cos, 0.0, 1.0)), 0.25, 0.75)
        return unit((1 - alpha) * long_ + alpha * short)

    @cached_property
    def kar_users(self) -> np.ndarray:
        """The cases' own vectors; those without one have 0."""
        n = np.diff(self.vec.offsets.to_numpy())
        out = np.zeros((self.rows, self.catalog.kar.shape[1]))
        out[n > 0] = self.vec.flatten().to_numpy().reshape(-1, out.shape[1])
        return out

    @cached_property
    def content(self) -> tuple[np.ndarray, np.ndarray]:
        """The 500 best by likeness to the weighted mean of the observed items (the last ten twice) that have a text."""
        like = self.catalog.like
        weights = np.zeros((self.rows, self.size))
        weights[self.seen_row, self.seen] = np.where(self.recent(10), 2.0, 1.0)
        total = weights[:, like.any(axis=1)].sum(axis=1, keepdims=True)
        self.content_scores = scores = weights @ like / np.where(total > 0, total, 1.0)
        key = rounded(scores) * self.size + (self.size - 1 - np.arange(self.size))
        return best(np.where((scores > 0) & ~self.is_seen, key, -1), 500)

    @cached_property
    def signature(self) -> np.ndarray:
        """What a case's profile follows from: which of the words of its observed items are more, and whether an artist
        has half of them. One of `SIGNATURES`."""
        votes = self.catalog.votes  # of each item: positive, negative, high, low, club, and the artist in lower case
        pos, neg, high, low, club = (np.bincount(self.seen_row, votes[self.seen, i], self.rows) for i in range(5))
        n = int(votes[:, 5].max(initial=0)) + 1
        by = np.bincount(self.seen_row * n + votes[self.seen, 5].astype(np.int64), minlength=self.rows * n).reshape(self.rows, n)
        half = 2 * by.max(axis=1, initial=0) >= self.n_seen
        return (((np.sign(pos - neg) + 1) * 3 + np.sign(high - low) + 1) * 4 + (club > 0) * 2 + half).astype(np.int64)

    def texts(self, titles: list[str], artists: list[str], terms: list[str], held: np.ndarray, sentence: str, window: int = 12) -> list[str]:
        """The knowledge text of each case, as knowledge.playlist_texts() has it. `artists` are the artists by number,
        `held` how often each item holds each of the `terms`, which are in order."""
        late = self.recent(window)

        def frequent(counts: np.ndarray, names: list[str], most: int) -> list[str]:
            at, n = best(np.where(counts > 0, counts.astype(np.int64) * counts.shape[1] + (counts.shape[1] - 1 - np.arange(counts.shape[1])), -1), most)
            return [" ".join(names[i] for i in row[:k]) for row, k in zip(at, n, strict=True)]

        def counted(which: np.ndarray) -> np.ndarray:
            weights = np.zeros((self.rows, self.size))
            weights[self.seen_row[which], self.seen[which]] = 1.0
            return weights @ held

        names: list[list[str]] = [[] for _ in range(self.rows)]
        for r, i in zip(self.seen_row[late].tolist(), self.seen[late].tolist(), strict=True):
            names[r].append(titles[i])
        every = (map("; ".join, names), frequent(self.by_artist, artists, 5), frequent(counted(np.ones(len(self.seen), bool)), terms, 18), frequent(counted(late), terms, 12))
        return [sentence % x for x in zip(*every, strict=True)]

    # ---- the learned re-ranker

    @cached_property
    def features(self) -> np.ndarray:
        """Of the pool's candidates, in the order of adapter.FEATURES."""
        own = {"popularity" if n == "pop" else n: x for n, x in self.norms.items()}
        scalars = [own[n] if n in own else own[n.split("_")[0]] * own[n.split("_")[1]] for n in SCALARS]
        kar = np.zeros((*self.pool[0].shape, len(KAR_PRODUCTS)))
        width = min(len(KAR_PRODUCTS), self.catalog.kar.shape[1])
        kar[..., :width] = self.kar_users[:, None, :width] * self.catalog.kar[self.pool[0]][..., :width]
        return np.concatenate([np.stack(scalars, axis=2), kar], axis=2)

    @cached_property
    def valid(self) -> np.ndarray:
        """The filled cells of the pool."""
        return np.arange(self.pool[0].shape[1])[None, :] < self.pool[1][:, None]

    @cached_property
    def labels(self) -> np.ndarray:
        return np.take_along_axis(self.is_held, self.pool[0], 1) & self.valid

    def pairs(self, per_positive: int, draws: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
        """Rows of cases, cells of held-out candidates, numbers of pairs, and cells of the drawn others: of those of a case
        in the order of ids, the one that the draw (of the held-out items, in their order) says."""
        others = self.valid & ~self.labels
        n = others.sum(axis=1)
        r, c = np.nonzero(self.labels & (n > 0)[:, None])
        row, cell, j = np.repeat(r, per_positive), np.repeat(c, per_positive), np.tile(np.arange(per_positive), len(r))
        if draws is None:
            return row, cell, j + 1, None
        where = np.zeros((self.rows, self.size), np.int64)
        where[self.held_row, self.held] = np.arange(len(self.held))
        by_id = np.argsort(np.where(others, self.pool[0], self.size), axis=1, kind="stable")
        k = np.mod(draws.reshape(-1, per_positive)[where[row, self.pool[0][row, cell]], j], n[row])
        return row, cell, j + 1, by_id[row, k]

    # ---- ranks

    def ranked(self, pool: tuple[np.ndarray, np.ndarray], norms: dict[str, np.ndarray], weights: dict[str, float], names: list[str], top: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items, how many, and scores of the best by weighted norms, summed up in the order of `names`."""
        score = sum((weights.get(n, 0.0) * norms[n] for n in names[1:]), weights.get(names[0], 0.0) * norms[names[0]])
        at, n = pool
        valid = np.arange(at.shape[1])[None, :] < n[:, None]
        key = np.where(valid, rounded(score) * self.size + (self.size - 1 - at), -1)
        where, k = best(key, top)
        return np.take_along_axis(at, where, 1), k, np.take_along_axis(score, where, 1)

    def measured(self, at: np.ndarray, n: np.ndarray, k: int = 10) -> tuple[int, float, float]:
        """Cases with a ranking and something held out, and their sums of recall and NDCG."""
        at = at[:, :k]
        place = np.arange(at.shape[1])
        hit = np.take_along_axis(self.is_held, at, 1) & (place < n[:, None])
        gain = 1 / np.log2(place + 2.0)
        ideal = np.cumsum(1 / np.log2(np.arange(1, k + 1) + 1.0))
        rows = (n > 0) & (self.n_true > 0)
        true = self.n_true[rows]
        return int(rows.sum()), float((hit[rows].sum(axis=1) / true).sum()), float(((hit[rows] * gain).sum(axis=1) / ideal[np.minimum(true, k) - 1]).sum())

    def found(self, which: np.ndarray) -> tuple[int, float]:
        """Held-out items (cells of `which`) that are found, and the sum of the cases' shares."""
        hits = np.bincount(self.held_row[which], minlength=self.rows)
        return int(hits.sum()), float((hits[self.n_true > 0] / self.n_true[self.n_true > 0]).sum())

    def grid(self) -> Iterator[tuple[str, int, int, float]]:
        """method, pool, held-out items found, sum of their shares: for each pool size and share of the same artist.

        Pools aren't made: with f items of the quota before an item at place b of the base list, it is the (b - f)th of
        those after the quota."""
        place = lambda route: self.places(route)[self.held_row, self.held]
        a, b = place(self.artist), place(self.base)
        base, k = self.base
        own = np.where(np.arange(base.shape[1])[None, :] < k[:, None], np.take_along_axis(self.places(self.artist), base, 1), 1 << 30)
        n_artist = self.artist[1][self.held_row]
        for r in RATIOS:
            for p in POOLS:
                q = quota(p, r)
                before = np.cumsum(own <= q, axis=1)
                before = np.hstack([np.zeros((self.rows, 1), np.int64), before])[self.held_row, np.minimum(b, base.shape[1] + 1) - 1]
                yield (f"CF + artist{int(r * 100)}% + popularity", p, *self.found((a <= q) | ((b <= p) & (np.minimum(n_artist, q) + b - before <= p))))
        for name, route in (("Popularity", self.unseen), ("CF", self.cf_ordered)):
            at = place(route)
            for p in POOLS:
                yield (name, p, *self.found(at <= p))

    def places(self, route: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Each item's place in a list, from 1; a large number where it has none."""
        at, n = route
        out = np.full((self.rows, self.size), 1 << 30, np.int64)
        r, c = np.nonzero(np.arange(at.shape[1])[None, :] < n[:, None])
        out[r, at[r, c]] = c + 1
        return out


#: share, pos, neg, high, low, club that stand for each signature of a case.
SIGNATURES = [(0.5 if i & 1 else 0.25, int(i // 12 == 2), int(i // 12 == 0), int(i // 4 % 3 == 2), int(i // 4 % 3 == 0), i >> 1 & 1) for i in range(36)]


def case_rows(block: Block, route: tuple[np.ndarray, np.ndarray], place: str | None = None, **columns: np.ndarray) -> pa.RecordBatch:
    """A row for each item of each list: case_idx, song_id, other cells of the same place (or values in this order),
    the place from 1."""
    at, n = route
    r, c = np.nonzero(np.arange(at.shape[1])[None, :] < n[:, None])
    out = {"case_idx": pa.array(block.case[r], pa.int32()), "song_id": block.catalog.names.take(pa.array(at[r, c]))}
    out |= {k: pa.array(x if x.ndim == 1 else x[r, c]) for k, x in columns.items()}
    if place:
        out[place] = pa.array((c + 1).astype(np.int32))
    return pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


def blocks(batches: Iterator[pa.RecordBatch], catalog: Catalog) -> Iterator[Block]:
    """The cases in blocks that bound the matrices."""
    most = max(1, min(CASES, CELLS // max(1, len(catalog.ids))))
    for b in batches:
        ends = b.column("songs").offsets.to_numpy()
        lo = 0
        while lo < b.num_rows:
            n = max(1, min(most, int(np.searchsorted(ends[lo:], ends[lo] + HELD, "right")) - 1))
            yield Block(catalog, b.slice(lo, n))
            lo += n


def run(cases: DataFrame, catalog: Catalog, emit: Callable[[Block], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What `emit` makes of each block of cases (case_idx, playlist_id, songs, n_seen)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, catalog):
            yield from emit(block)

    return cases.mapInArrow(of, schema)


def sums(cases: DataFrame, catalog: Catalog, emit: Callable[[Block], Iterator[tuple]], keys: dict[str, str], values: int) -> DataFrame:
    """Totals of what `emit` gives for each block: keys, how many, and `values` sums. A task passes on one row for each
    key."""
    names = [*keys, "n", *(f"s{i}" for i in range(values))]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, list] = {}
        for block in blocks(batches, catalog):
            for row in emit(block):
                old = total.setdefault(row[: len(keys)], [0] * (values + 1))
                for i, x in enumerate(row[len(keys) :]):
                    old[i] += x
        if total:
            columns = list(zip(*((*k, v[0], *map(float, v[1:])) for k, v in total.items()), strict=True))
            own = [pa.array(c, pa.string() if t == "string" else pa.int32()) for c, t in zip(columns, keys.values())]
            yield pa.RecordBatch.from_arrays([*own, pa.array(columns[len(keys)], pa.int64()), *(pa.array(c, pa.float64()) for c in columns[len(keys) + 1 :])], names=names)

    schema = ", ".join([*(f"{k} {t}" for k, t in keys.items()), "n long", *(f"s{i} double" for i in range(values))])
    return cases.mapInArrow(of, schema).groupBy(*keys).agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(values)))


def pairs_of(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    """The observed pairs of each case as numbers, the smaller item first, about `PAIRS` at a time."""
    songs, seen = batch.column("songs"), batch.column("n_seen").to_numpy()
    offsets, items = songs.offsets.to_numpy(), songs.flatten().to_numpy()
    begin, codes, held = offsets[:-1] - offsets[0], [], 0
    for n in np.unique(seen):
        at = items[begin[seen == n][:, None] + np.arange(n)].astype(np.int64)
        for i in range(1, n):  # every item with the one i places after it
            step = max(1, PAIRS // (n - i))
            for lo in range(0, len(at), step):
                a, z = at[lo : lo + step, :-i], at[lo : lo + step, i:]
                codes.append((np.minimum(a, z) * size + np.maximum(a, z)).ravel())
                held += codes[-1].size
                if held >= PAIRS:
                    yield np.concatenate(codes)
                    codes, held = [], 0
    if codes:
        yield np.concatenate(codes)


def cooccurrence(cases: DataFrame, size: int) -> DataFrame:
    """src, dst, n: cases that observed both items, by number and in both directions. A task adds up a matrix; its rows
    are added over the tasks."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for b in batches:
            for codes in pairs_of(b, size):
                total += np.bincount(codes, minlength=size * size)
        total = total.reshape(size, size)
        for src in np.nonzero(total.any(axis=1))[0]:
            yield pa.RecordBatch.from_arrays([pa.array([src], pa.int32()), pa.array([total[src].tobytes()], pa.binary())], names=["src", "counts"])

    def added(parts: pa.Table) -> pa.Table:
        total = np.zeros(size, np.int64)
        for x in parts["counts"]:
            total += np.frombuffer(x.as_buffer(), np.int64)
        dst = np.nonzero(total)[0]
        return pa.table({"src": np.full(len(dst), parts["src"][0].as_py(), np.int32), "dst": dst.astype(np.int32), "n": total[dst]})

    once = cases.select("songs", "n_seen").mapInArrow(counted, "src int, counts binary").groupBy("src").applyInArrow(added, "src int, dst int, n long")
    both = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return once.select(F.explode(both).alias("p"), "n").select("p.src", "p.dst", "n")
