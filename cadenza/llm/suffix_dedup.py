"""Exact removal of repeated substrings by two-stage suffix sorting.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else in the corpus. To bring
equal strings together without sorting the corpus as a whole:

1. Every window of LENGTH bytes has an anchor, its GRAM-byte string with the least hash. Equal windows have
   equal anchors at the same offset. Windows with one anchor are neighbours and form a segment.
2. Anchors are counted by hash; one that occurs once settles its windows. Segments with an equal anchor fall
   into classes of equal bytes; all windows of a class with two members or more are repeated.
3. What stays open are anchors around which segments differ, the edges of repeated passages. One segment of
   each class travels to the anchor's block, and a block's text is sorted in two stages: suffixes that are
   smaller than their successors are sorted directly, no others, and those are induced from them by a scan of
   the buckets; the common prefixes of neighbours then tell which windows occur twice.

Segments are compared by 64-bit hashes of anchor and content; both would have to collide. The counts are
aggregates (combined before they are shuffled), and the join with them leaves out anchors that very many
segments have, which are broadcast; anchors with more than DEALT differing segments are sorted as pairs of blocks.

Defined results: null text is the empty text; texts shorter than LENGTH lose nothing; overlapping
occurrences count, in the same document too; strings are judged on the input; repeated rows repeat each
other's text; an empty table gives no rows; other columns are kept or ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.common import LARGE, Scratch, give_back, join_keys, text_batches, text_of, tidy

LENGTH = 200
GRAM = 50
#: Bytes of a text that are handled at a time.
CHUNK = 1 << 18
#: Differing segments of one anchor that are sorted together.
DEALT = 1024
#: Bytes of a block on average, and the bits for a place in it.
BLOCK, BITS = 1 << 19, 21
_BASE = 0x9E3779B97F4A7C15


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    inverse = 1
    for _ in range(6):
        inverse = inverse * (2 - _BASE * inverse) % (1 << 64)
    out = []
    for b in (_BASE, inverse):
        p = np.full(CHUNK + LENGTH + 1, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


_UP, _DOWN = _powers()


def _mixed(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def segments(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """For each anchor of a text: the hash of its gram, the hash of its segment, its place, and the first
    and last window that it stands for."""
    width = length - gram + 1  # grams in a window
    for base in range(0, len(raw) - length + 1, CHUNK):
        part = raw[base : base + CHUNK + length - 1]
        n, windows = len(part), len(part) - length + 1
        # hashes of all grams, from sums of the bytes times powers of the base
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((np.frombuffer(part, np.uint8).astype(np.uint64) + np.uint64(1)) * _UP[:n], out=total[1:])
        grams = _mixed((total[gram:] - total[:-gram]) * _DOWN[: n - gram + 1])
        # the least gram of each window (the first of equal ones): minima of blocks from both sides
        place = np.uint64((1 << 20) - 1)
        keyed = np.full(-(-len(grams) // width) * width, np.uint64(2**64 - 1))
        keyed[: len(grams)] = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
        keyed = keyed.reshape(-1, width)
        left = np.minimum.accumulate(keyed, axis=1).ravel()
        right = np.minimum.accumulate(keyed[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(right[:windows], left[width - 1 : width - 1 + windows]) & place).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:], windows] - 1
        anchor = at[first]
        size, offset = (last + length - first).astype(np.uint64), (anchor - first).astype(np.uint64)
        content = _mixed((total[last + length] - total[first]) * _DOWN[first] + size * np.uint64(0xC2B2AE3D27D4EB4F) + offset * np.uint64(0x165667B19E3779F9))
        yield grams[anchor], content, anchor + base, first + base, last + base


def _anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, found, heads = batch.slice(lo, 256), [], []
                for k, text in enumerate(part.column(2)):
                    raw = text.as_py().encode()
                    for s in segments(raw, length, gram) if len(raw) >= length else ():
                        head = np.zeros(len(s[0]), bool)
                        head[0] = not heads or heads[-1] != k
                        heads.append(k)
                        found.append((*s, np.full(len(s[0]), k), head))
                uids = uid + np.arange(part.num_rows)
                uid += part.num_rows
                if not found:
                    continue
                anchor, content, at, first, last, who, head = (np.concatenate(c) for c in zip(*found, strict=True))
                # place, windows before the anchor and windows in all, in one number
                where = (at << 20) | ((at - first) << 10) | (last - first)
                none = pa.nulls(len(who), pa.int64())
                docs, textids = part.column(0).take(pa.array(who)), part.column(1).take(pa.array(who))
                mask = pa.array(head)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(uids[who]), pa.array(where), pc.if_else(mask, docs, none), pc.if_else(mask, textids, none)],
                    names=["anchor", "content", "uid", "place", "doc_id", "textid"],
                )

    return run


class Words:
    """Eight bytes of a text from any place on as one number, most significant first; 0 past the end."""

    def __init__(self, text: np.ndarray):
        self.n = len(text)
        padded = np.concatenate([text.astype(np.uint64), np.zeros(8, np.uint64)])
        self.at = np.zeros(self.n + 1, np.uint64)
        for k in range(8):
            self.at[: self.n] = (self.at[: self.n] << np.uint64(8)) | padded[k : k + self.n]

    def __call__(self, places: np.ndarray, count: int = 8) -> np.ndarray:
        """The first `count` bytes of each word."""
        words = self.at[np.minimum(places, self.n)]
        return words if count >= 8 else words >> np.uint64(64 - 8 * count)


def sort_directly(words: Words, places: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the `depth` bytes from them on: by eight bytes, then what is tied by five at a time,
    which with the number of its group make one sort key."""
    key = words(places, depth)
    by = np.argsort(key)
    places, key = places[by], key[by]
    group, done = np.cumsum(np.r_[True, key[1:] != key[:-1]][: len(places)]).astype(np.uint64), 8
    tied = _tied(group)
    while done < depth and len(tied):
        own = group[tied]
        dense = np.cumsum(np.r_[True, own[1:] != own[:-1]]).astype(np.uint64)
        key = (dense << np.uint64(40)) | words(places[tied] + done, min(5, depth - done))
        by = np.argsort(key)
        places[tied], key = places[tied][by], key[by]
        group[tied] = own = np.cumsum(np.r_[True, key[1:] != key[:-1]]).astype(np.uint64)
        tied = tied[_tied(own)]
        done += 5
    return places


def _tied(group: np.ndarray) -> np.ndarray:
    """Where neighbours are of one group."""
    same = group[1:] == group[:-1]
    return np.flatnonzero(np.r_[False, same] | np.r_[same, False]) if len(group) > 1 else np.empty(0, np.int64)


def common_prefixes(words: Words, order: np.ndarray, depth: int) -> np.ndarray:
    """How many bytes, up to `depth`, each suffix has in common with the one before it in the order; past the end
    stand zeros, as in the order."""
    a, b = order[:-1], order[1:]
    out = np.full(len(a), depth, np.int64)
    alive, done = np.arange(len(a)), 0
    while done < depth and len(alive):
        x = words(a[alive] + done) ^ words(b[alive] + done)
        differ = x != 0
        equal = sum((x >> np.uint64(64 - 8 * j) == 0).astype(np.int64) for j in range(1, 8))
        out[alive[differ]] = done + equal[differ]
        alive = alive[~differ]
        done += 8
    return np.minimum(out, depth)


def suffix_array(text: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of a text in the order of their first `depth` bytes, what each has in common with the one
    before it (up to `depth`), and the places of those that were sorted directly."""
    n = len(text)
    if n >= 1 << BITS:
        raise ValueError("a block is too long")
    words = Words(text)

    # a suffix is smaller than its successor where the next different byte is larger; the last is larger
    change = np.flatnonzero(np.r_[text[1:] != text[:-1], True]) if n else np.empty(0, np.int64)
    rises = np.r_[text[change[:-1]] < text[change[:-1] + 1], False] if n else np.empty(0, bool)
    smaller = np.repeat(rises, np.diff(np.r_[-1, change]))

    # first stage: those are sorted directly, and no other
    direct = sort_directly(words, np.flatnonzero(smaller), depth)

    # second stage: a scan of the buckets, by first byte, induces the others from them
    first_byte = text[direct]
    starts = np.searchsorted(first_byte, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n:
        waiting[text[n - 1]].append(np.array([n - 1]))  # its successor is the empty suffix, the least of all
    out: list[np.ndarray] = []

    def induce(scanned: np.ndarray, bucket: int) -> np.ndarray:
        """Put the larger ones before the scanned suffixes into their buckets; those of this bucket are returned."""
        before = scanned[scanned > 0] - 1
        before = before[~smaller[before]]
        byte = text[before]
        here = before[byte == bucket]
        before, byte = before[byte != bucket], byte[byte != bucket]
        if len(before):
            by = np.argsort(byte, kind="stable")
            before, byte = before[by], byte[by]
            cuts = np.flatnonzero(byte[1:] != byte[:-1]) + 1
            for piece, b in zip(np.split(before, cuts), byte[np.r_[0, cuts]], strict=True):
                waiting[b].append(piece)
        return here

    for bucket in range(256):
        wave = np.concatenate(waiting[bucket]) if waiting[bucket] else np.empty(0, np.int64)
        while len(wave):
            out.append(wave)
            wave = induce(wave, bucket)
        own_part = direct[starts[bucket] : starts[bucket + 1]]
        if len(own_part):
            out.append(own_part)
            induce(own_part, bucket)
    order = np.concatenate(out) if out else np.empty(0, np.int64)
    return order, common_prefixes(words, order, depth), direct


def repeated_windows(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each string, which of its windows also stand elsewhere in the strings."""
    text = np.frombuffer(b"\0".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    order, common, _ = suffix_array(text, length)
    whole = np.zeros(len(text) + 1, np.int64)  # windows that don't reach over the end of their string
    np.add.at(whole, starts, 1)
    np.add.at(whole, starts + np.maximum(sizes - length + 1, 0), -1)
    whole = np.cumsum(whole)[:-1] > 0
    at = np.flatnonzero(whole[order])
    order = order[at]
    # what neighbours among them have in common is the least of what lies between
    same = np.minimum.reduceat(common[: at[-1]], at[:-1]) >= length if len(at) > 1 else np.empty(0, bool)
    twice = np.zeros(len(text), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return [twice[s : s + max(0, k - length + 1)] for s, k in zip(starts.tolist(), sizes.tolist(), strict=True)]


def _settle(length: int):
    def run(block: pa.Table) -> pa.Table:
        """The repeated windows of a block's open segments, as spans of their documents."""
        raw, uids, starts, open_ = (block[c].to_pylist() for c in ("raw", "uid", "start", "open"))
        by_anchor: dict[int, list[int]] = {}
        seen: set[tuple[int, int]] = set()  # equal rows of the table bring a segment several times
        for i, (a, key) in enumerate(zip(block["anchor"].to_pylist(), zip(uids, starts, strict=True), strict=True)):
            if key not in seen:
                seen.add(key)
                by_anchor.setdefault(a, []).append(i)
        spans: list[tuple[int, int, int]] = []

        def sort(rows: list[int]) -> None:
            for i, hit in zip(rows, repeated_windows([raw[i] for i in rows], length), strict=True):
                if open_[i] and hit.any():
                    edge = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
                    spans.extend((uids[i], starts[i] + a, starts[i] + b - 1 + length) for a, b in edge.reshape(-1, 2).tolist())

        rows, size = [], 0
        for group in by_anchor.values():  # whole anchors, as many as a block holds
            own = sum(len(raw[i]) + 1 for i in group)
            if rows and size + own >= BLOCK:
                sort(rows)
                rows, size = [], 0
            rows += group
            size += own
        if rows:
            sort(rows)
        if block.nbytes > LARGE:
            give_back()
        u, a, b = zip(*spans, strict=True) if spans else ((), (), ())
        return pa.table({"uid": pa.array(u, pa.int64()), "start": pa.array(a, pa.int64()), "end": pa.array(b, pa.int64())})

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of the segments that a document gives."""
        for batch in batches:
            uid, anchor, start, raw, open_ = [], [], [], [], []
            for text, reps in zip(batch.column(0), batch.column(1), strict=True):
                own = text.as_py().encode()
                for r in reps.as_py():
                    at, before, more = r["place"] >> 20, (r["place"] >> 10) & 1023, r["place"] & 1023
                    first = at - before
                    uid.append(r["uid"])
                    anchor.append(r["anchor"])
                    start.append(first)
                    raw.append(own[first : first + more + length])
                    open_.append(r["n"] == 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid, pa.int64()), pa.array(anchor, pa.int64()), pa.array(start, pa.int64()), pa.array(raw, pa.binary()), pa.array(open_, pa.bool_())],
                names=["uid", "anchor", "start", "raw", "open"],
            )

    return run


def repeated_spans(spark: SparkSession, docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, textid (hash of the text), spans (array of start, end) of the documents that lose something.
    `docs`: doc_id, textid, text."""
    if not gram < length <= gram + 900:
        raise ValueError("windows take more than a gram, and at most 900 bytes more")
    scratch = Scratch(spark, "suffix-dedup")
    schema = "anchor long, content long, uid long, place long, doc_id long, textid long"
    anchors = scratch.write(text_batches(docs).select("doc_id", "textid", "text").mapInArrow(tidy(_anchors(length, gram)), schema))
    names = scratch.write(anchors.where("textid is not null").select("uid", "doc_id", "textid"))
    again = (
        anchors.groupBy("anchor")
        .agg(F.count("*").alias("n"), (F.min("content") != F.max("content")).alias("differs"))
        .where("n > 1")
    )
    hits = scratch.write(join_keys(anchors.select("anchor", "content", "uid", "place"), again, "anchor", anchors.count()))
    scratch.drop(anchors)
    # classes of equal segments around the anchors where segments differ
    classes = scratch.write(hits.where("differs").groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(F.struct("uid", "place")).alias("rep")))
    at, before, more = F.shiftright("place", 20), F.shiftright("place", 10).bitwiseAND(F.lit(1023)), F.col("place").bitwiseAND(F.lit(1023))
    whole = hits.where("not differs").select("uid", "place").unionByName(
        hits.where("differs").join(classes.where("n > 1").select("anchor", "content"), ["anchor", "content"]).select("uid", "place")
    )
    whole = whole.select("uid", (at - before).alias("start"), (at - before + more + length).alias("end"))
    # of each class one segment goes on, unless all classes around the anchor have several
    of_anchor = classes.groupBy("anchor").agg(F.count("*").alias("segments"), F.min("n").alias("least")).where("least = 1")
    reps = classes.join(of_anchor, "anchor").select("rep.uid", F.struct("rep.uid", "anchor", "rep.place", "n", "segments").alias("r"))
    by_doc = reps.groupBy("uid").agg(F.collect_list("r").alias("reps")).join(names, "uid")
    # equal rows of the table give their segments once
    by_text = by_doc.groupBy("doc_id", "textid").agg(F.flatten(F.collect_list("reps")).alias("reps"))
    same = F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.textid") == F.col("r.textid"))
    raw = docs.alias("d").join(by_text.alias("r"), same).select("d.text", "r.reps").mapInArrow(tidy(_cut(length)), "uid long, anchor long, start long, raw binary, open boolean")
    raw = raw.join(of_anchor.select("anchor", "segments"), "anchor")
    total = (classes.agg(F.count("*")).first()[0] or 0) * (length + length // 2)
    blocks = max(1, -(-total // BLOCK))
    parts = F.ceil(F.col("segments") / DEALT).cast("int")
    mine = F.pmod(F.xxhash64("uid", "start"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, F.col("mine")).alias("i"), F.greatest(k, F.col("mine")).alias("j")))
    dealt = (
        raw.withColumn("parts", parts)
        .withColumn("mine", mine)
        .withColumn("block", F.when(F.col("parts") > 1, F.col("anchor")).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(blocks))))
        .select("block", "anchor", "uid", "start", "raw", "open", F.explode(pairs).alias("p"))
        .select("block", "p.i", "p.j", "anchor", "uid", "start", "raw", "open")
    )
    edges = dealt.groupBy("block", "i", "j").applyInArrow(_settle(length), "uid long, start long, end long")
    spans = whole.unionByName(edges)
    # neighbours overlap: they are joined before they are gathered by document
    order = Window.partitionBy("uid").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum((F.col("fresh")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    merged = (
        spans.withColumn("fresh", F.coalesce(F.col("start") > reach, F.lit(True)))
        .withColumn("run", run)
        .groupBy("uid", "run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
    )
    per_doc = merged.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    return per_doc.join(names, "uid").groupBy("doc_id", "textid").agg(F.min_by("spans", "uid").alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", out: str = "removal", decode: bool = False) -> DataFrame:
    """`docs` with a struct `out`: kept (bytes), n_bytes, n_removed, n_spans, kept_sha256; with `decode` also
    kept_text, the kept bytes without what is left of characters that were cut in two."""
    text = text_of(text_col)
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("textid"), text.alias("text"))
    spans = repeated_spans(docs.sparkSession, keyed, length, gram)
    kind = "struct<kept: binary, n_bytes: long, n_removed: long, n_spans: long, kept_sha256: string, kept_text: string>"
    fields = [("kept", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())]

    @F.arrow_udf(kind)
    def remove(texts: pa.Array, spans: pa.Array) -> pa.Array:
        columns: list[list] = [[] for _ in fields]
        for t, own in zip(texts, spans, strict=True):
            raw, parts, at, own = t.as_py().encode(), [], 0, own.as_py() or ()
            for s in own:
                parts.append(raw[at : s["start"]])
                at = s["end"]
            kept = b"".join([*parts, raw[at:]])
            row = (kept, len(raw), len(raw) - len(kept), len(own), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if decode else None)
            for column, v in zip(columns, row, strict=True):
                column.append(v)
        return pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    ours = spans.select(F.col("doc_id").alias("__doc"), F.col("textid").alias("__textid"), F.col("spans").alias("__spans"))
    joined = docs.join(ours, F.col(id_col).cast("long").eqNullSafe(F.col("__doc")) & (F.xxhash64(text) == F.col("__textid")), "left")
    return joined.withColumn(out, remove(text, F.col("__spans"))).drop("__doc", "__textid", "__spans")
