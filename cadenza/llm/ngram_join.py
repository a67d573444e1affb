"""Exact Jaccard join of word shingle sets, and the groups that it links.

1. Documents with the same set fall into one class; only one of each goes on.
2. Prefix filter. In any one order of all shingles, two sets that link share one of their first
   |x| - ceil(t |x|) + 1. The order here: a quarter of the shingles (by hash) first, the rarest leading,
   then the others by hash; so frequencies are needed, and shuffled, for that quarter only. Shingles travel
   in packed blocks by range of their hash; a range that very frequent shingles fill is counted by rows
   instead, with partial aggregates and a join that Spark can split.
3. Documents that share a shingle of their prefixes form clusters; each document travels to a block of its
   cluster once.
4. T-occurrence search in a block: a document is the query against those that aren't linked yet. The
   short inverted lists are merged; what occurs often enough there is probed for in the long lists by
   binary search (DivideSkip), and documents that reach the required overlap link. Documents that have been
   linked leave the index and become queries themselves, so a group of copies takes few comparisons, and
   no link between different groups is missed.
5. Clusters of more than a block: rounds of searches among a few documents of each group join the groups that
   different blocks found of one family. Only documents with a prefix shingle that several groups hold can
   still link; they are searched by such shingles, those of one least holder together. Where these take more
   than a block, they are searched as pairs of blocks, but those of the largest group not among themselves.
   So a family of any size takes work in proportion to its documents.
6. Links are joined into components.

Defined results: null or empty text, and text of white space only, has an empty set and links with nothing;
with fewer words than a shingle takes, all words together are the one shingle; rows with one id are
documents of their own; a null id is greater than all others; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import LARGE, Scratch, give_back, grown, join_keys, text_batches, text_of, tidy
from cadenza.llm.components import components

#: Shingles whose hash is below this lead the order, by frequency.
LEADING = np.uint64(1 << 62)
#: Documents, and characters of their texts, that are searched at a time.
BLOCK, BLOCK_CHARS = 2048, 8 << 20
#: Documents of a group that stand for it in a round.
STAND_FOR = 16
#: Shingles that a block's task holds, on average.
BUCKET = 1 << 20
#: Postings of short lists that are merged by a heap.
HEAPED = 4096
#: Words whose hashes a Python worker remembers.
CACHE = 250_000
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


class Shingler:
    """Sets of hashed word shingles; A-Z are lower-cased, words are `[^\\x20\\x09-\\x0D]+`."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def __call__(self, text: str) -> np.ndarray:
        """The distinct shingles of a text, sorted, as unsigned 64-bit hashes."""
        words = text.encode().lower().split()
        if not words:
            return np.empty(0, np.uint64)
        k = min(self.words, len(words))
        known = self.known
        if len(known) > CACHE:
            known.clear()
        try:
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            known.update((w, xxhash.xxh3_64_intdigest(w)) for w in set(words) if w not in known)
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = len(h) - k + 1
        out = np.full(n, k, np.uint64)
        for i in range(k):
            x = h[i : i + n] * _MULTIPLIERS[i % 8] + np.uint64(i)
            out = (out ^ (x ^ (x >> np.uint64(31)))) * _MULTIPLIERS[(i + 3) % 8]
        out ^= out >> np.uint64(29)
        return np.unique(out * _MULTIPLIERS[1])


def prefix_length(n: np.ndarray | int, num: int, den: int):
    """|x| - ceil(t |x|) + 1 for the similarity t = num / den."""
    return n + (-num * n) // den + 1


def _sets(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """A row for each document: uid, doc_id, textid, n, lead (shingles that lead), characters, digest of the
    set, and the shingles that may be in its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, uid = Shingler(words), TaskContext.get().partitionId() << 36
        for batch in batches:
            ns, leads, chars, digests, packed = [], [], [], [], []
            for text in (x.as_py() for x in batch.column(2)):
                s = shingle(text)
                chars.append(len(text))
                lead = int(np.searchsorted(s, LEADING))
                ns.append(len(s))
                leads.append(lead)
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                packed.append(s[: max(lead, prefix_length(len(s), num, den))].astype("<u8").tobytes() if len(s) else b"")
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(uid, uid + n), pa.int64()), batch.column(0), batch.column(1), pa.array(ns, pa.int64()), pa.array(leads, pa.int64()), pa.array(chars, pa.int64()), pa.array(digests, pa.binary()), pa.array(packed, pa.binary())],
                names=["uid", "doc_id", "textid", "n", "lead", "chars", "digest", "shingles"],
            )
            uid += n

    return text_batches(docs).mapInArrow(tidy(run), "uid long, doc_id long, textid long, n long, lead long, chars long, digest binary, shingles binary")


def _blocks(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shingles and the documents that hold them, by range of the hash."""
        for batch in batches:
            raw = batch.column(1).to_pylist()
            if not raw:
                continue
            s = np.frombuffer(b"".join(raw), "<u8")
            who = np.repeat(batch.column(0).to_numpy(), [len(x) // 8 for x in raw])
            at = np.argsort(s, kind="stable")
            s, who = s[at], who[at]
            cut = np.searchsorted(s, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
            ends = [*cut[1:].tolist(), len(s)]
            rows = [(b, s[i:j].tobytes(), who[i:j].tobytes()) for b, (i, j) in enumerate(zip(cut.tolist(), ends, strict=True)) if j > i]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
                names=["bucket", "shingles", "uids"],
            )

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks as rows: uid, shingle."""
    for batch in batches:
        for shingles, uids in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(uids, "<i8")), pa.array(np.frombuffer(shingles, "<i8"))], names=["uid", "shingle"])


def _counted(bucket: pa.Table) -> pa.Table:
    """The shingles of a range that several documents hold: uid, shingle, how many hold it."""
    s = np.frombuffer(b"".join(bucket["shingles"].to_pylist()), "<u8")
    who = np.frombuffer(b"".join(bucket["uids"].to_pylist()), "<i8")
    at = np.argsort(s, kind="stable")
    s, who = s[at], who[at]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    held = np.repeat(np.diff(np.r_[first, len(s)]), np.diff(np.r_[first, len(s)]))
    keep = held > 1
    out = pa.table({"uid": who[keep], "shingle": s[keep].view("<i8"), "held": held[keep].astype(np.int64)})
    del s, who, at, first, held, keep
    give_back()
    return out


def shared_shingles(sets: DataFrame, total: int) -> DataFrame:
    """uid, shingle, held (documents that hold it) of the shingles that several hold; `total` of all.

    Ranges of the hash have BUCKET shingles on average. A sample of a sixteenth tells which have more than
    four times that, as very frequent shingles fall there: those are counted by rows. It decides on the way only."""
    bits = max(6, (total // BUCKET).bit_length())
    schema = "bucket int, shingles binary, uids binary"
    blocks = sets.mapInArrow(tidy(_blocks(bits)), schema)
    size = F.octet_length("shingles") / 8
    sampled = sets.where(F.pmod(F.xxhash64("uid"), F.lit(16)) == 0).mapInArrow(_blocks(bits), schema)
    full = [r.bucket for r in sampled.groupBy("bucket").agg(F.sum(size).alias("n")).where(F.col("n") * 16 > 4 * BUCKET).select("bucket").collect()]
    if not full:
        return blocks.groupBy("bucket").applyInArrow(_counted, "uid long, shingle long, held long")
    rest = blocks.where(~F.col("bucket").isin(full)).groupBy("bucket").applyInArrow(_counted, "uid long, shingle long, held long")
    rows = blocks.where(F.col("bucket").isin(full)).mapInArrow(_rows, "uid long, shingle long")
    counts = rows.groupBy("shingle").agg(F.count("*").alias("held")).where("held > 1")
    return rest.unionByName(rows.join(grown(counts), "shingle").select("uid", "shingle", "held"))


class Index:
    """Inverted lists of sets: the documents that hold shingle k, in ascending order, are the `count[k]` of
    `posting` from `start[k]` on. Documents that are no longer wanted are taken out once they are half of all."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        _, self.lists = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_inverse=True)
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)
        self.own = np.split(self.lists, np.cumsum(self.sizes)[:-1]) if len(sets) else []
        self.free = self.sizes > 0
        self.build()

    def build(self) -> None:
        held = self.free[self.owner]
        owner, lists = self.owner[held], self.lists[held]
        order = np.argsort(lists, kind="stable")
        self.count = np.bincount(lists, minlength=int(self.lists.max(initial=-1)) + 1)
        self.start = np.cumsum(self.count) - self.count
        self.posting = owner[order]
        self.built = self.left = int(self.free.sum())

    def take(self, docs: list[int]) -> None:
        self.free[docs] = False
        self.left -= len(docs)
        if 2 * self.left < self.built:
            self.build()


def heap_merge(lists: list[list[int]], least: int) -> dict[int, int]:
    """Documents in at least `least` of the lists, and in how many: a heap of the lists' heads. Where the
    smallest head is in too few, as many lists as can't matter without one more jump to the next head."""
    heads = [(x[0], 0, i) for i, x in enumerate(lists)]
    heapify(heads)
    found: dict[int, int] = {}
    while len(heads) >= least:
        doc = heads[0][0]
        popped = []
        while heads and heads[0][0] == doc:
            popped.append(heappop(heads))
        to = doc + 1
        if len(popped) >= least:
            found[doc] = len(popped)
        else:
            while heads and len(popped) < least - 1:
                popped.append(heappop(heads))
            if not heads:
                break
            to = heads[0][0]
        for _, at, i in popped:
            own = lists[i]
            at = bisect_left(own, to, at)
            if at < len(own):
                heappush(heads, (own[at], at, i))
    return found


def merge(lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents in at least `least` of the short lists, ascending, and in how many. Few postings go through
    the heap; of many each document is counted at once, which a heap of Python objects takes ten times as
    long for. Both give the same."""
    if sum(map(len, lists)) <= HEAPED:
        found = heap_merge([x.tolist() for x in lists], least)
        return np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))
    times = np.bincount(np.concatenate(lists))
    found = np.flatnonzero(times >= least)
    return found, times[found]


def search(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Pairs (i, j) that connect exactly the sets which any chain of links connects: 100 t percent of
    overlap, by T-occurrence search with DivideSkip. i is the first set of a group, j each other one."""
    index = Index(sets)
    sizes, free = index.sizes, index.free
    links: list[tuple[int, int]] = []
    for seed in range(len(sets)):
        if not free[seed]:
            continue
        index.take([seed])
        queue = [seed]
        for x in queue:
            n = int(sizes[x])
            need = -(-num * n // den)  # an overlap of less can't be enough for any size
            count = index.count[index.own[x]]
            mine, count = index.own[x][count > 0], count[count > 0]
            if len(mine) < need:
                continue
            order = np.argsort(count, kind="stable")
            mine, count = mine[order], count[order]
            # the longest lists are only probed: of `need` occurrences, need - skipped must be in the others
            skipped = min(need - 1, int(need / (0.01 * np.log2(max(2, count[-1])) + 1)))
            lists = [index.posting[a : a + k] for a, k in zip(index.start[mine].tolist(), count.tolist(), strict=True)]
            cut = len(lists) - skipped
            found, times = merge(lists[:cut], need - skipped)
            ok = free[found] & (sizes[found] * den >= num * n) & (n * den >= num * sizes[found])
            found, times = found[ok], times[ok]
            for i, docs in enumerate(lists[cut:], 1):
                if not len(found):
                    break
                at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
                times = times + (docs[at] == found)
                # what is needed with the document's own size, less the lists that are still to come
                alive = den * (times + skipped - i) >= num * (n + sizes[found] - times - skipped + i)
                found, times = found[alive], times[alive]
            linked = found[den * times >= num * (n + sizes[found] - times)].tolist()
            links += [(seed, y) for y in linked]
            queue += linked
            if linked:
                index.take(linked)
    return links


def _cluster(words: int, num: int, den: int):
    def run(cluster: pa.Table) -> pa.Table:
        shingle = Shingler(words)
        texts = dict(zip(cluster["uid"].to_pylist(), cluster["text"], strict=True))  # equal rows of the table count once
        uids = list(texts)
        links = search([shingle(t.as_py()) for t in texts.values()], num, den)
        if cluster.nbytes > LARGE:
            give_back()
        return pa.table({"a": pa.array([uids[i] for i, _ in links], pa.int64()), "b": pa.array([uids[j] for _, j in links], pa.int64())})

    return run


def _parts(docs, chars):
    """Blocks for so many documents and characters."""
    return F.ceil(F.greatest(docs / BLOCK, chars / BLOCK_CHARS)).cast("int")


def _place(parts):
    return F.pmod(F.xxhash64("uid"), parts).cast("int")


class Clusters:
    """The search in the clusters. members: uid, root (cluster), chars; texts: uid, text; prefix: uid, shingle."""

    def __init__(self, scratch: Scratch, members: DataFrame, texts: DataFrame, prefix: DataFrame, words: int, num: int, den: int):
        self.scratch, self.members, self.texts, self.prefix = scratch, members, texts, prefix
        self.find = _cluster(words, num, den)

    def search(self, rows: DataFrame, *keys: str) -> DataFrame:
        """Links (a, b) among the rows of equal keys."""
        return rows.groupBy(*keys).applyInArrow(self.find, "a long, b long")

    def links(self) -> DataFrame:
        sized = self.members.groupBy("root").agg(_parts(F.count("*"), F.sum("chars")).alias("parts"))
        dealt = self.members.join(grown(sized), "root").withColumn("mine", _place(F.col("parts")))
        links = self.scratch.write(self.search(dealt.join(grown(self.texts), "uid").select("root", "mine", "uid", "text"), "root", "mine"))
        if sized.where("parts > 1").isEmpty():
            return links
        # a document stands in one block, and there is either the first of its group or linked with that
        first = links.groupBy(F.col("b").alias("uid")).agg(F.min("a").alias("group"))
        large = dealt.where("parts > 1").join(grown(first), "uid", "left")
        groups = self.scratch.write(large.select("uid", "root", "chars", F.coalesce("group", "uid").alias("group")))
        while True:
            more, hooks, whole = self.round(groups)
            if hooks.isEmpty():
                break
            links = links.unionByName(more)
            groups = self.scratch.write(groups.join(grown(hooks), "group", "left").select("uid", "root", "chars", F.coalesce("parent", "group").alias("group")))
            if whole:
                break
        return links.unionByName(self.rest(groups))

    def round(self, groups: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
        """Links by documents that stand for groups of several in a cluster of several such; the groups that hook to
        others by them (group, parent); and whether those of each cluster were searched together. Groups needn't
        be joined wholly: they are names of connected documents, which `rest` needs as few of as possible."""
        several = groups.groupBy("group").agg(F.count("*").alias("n")).where("n > 1")
        one_in = F.ceil(F.col("n") / STAND_FOR)
        chosen = groups.join(grown(several), "group").where((F.col("n") <= STAND_FOR) | (F.pmod(F.xxhash64("uid", F.lit(1)), one_in) == 0) | (F.col("uid") == F.col("group")))
        sized = chosen.groupBy("root").agg(_parts(F.count("*"), F.sum("chars")).alias("parts"), F.min("group").alias("low"), F.max("group").alias("high")).where("low < high")
        chosen = self.scratch.write(chosen.join(grown(sized), "root").select("uid", "root", "group", "parts", _place(F.col("parts")).alias("mine")))
        most = chosen.agg(F.max("parts")).first()[0] or 1
        rows = chosen.join(grown(self.texts), "uid")
        links = self.scratch.write(self.search(rows.select("root", "mine", "uid", "text"), "root", "mine"))
        group_of = lambda c: grown(chosen.select(F.col("uid").alias(c), F.col("group").alias(f"group_{c}")))
        between = links.join(group_of("a"), "a").join(group_of("b"), "b").where("group_a != group_b")
        hooks = between.groupBy(F.greatest("group_a", "group_b").alias("group")).agg(F.min(F.least("group_a", "group_b")).alias("parent"))
        return links, self.scratch.write(hooks), most == 1

    def rest(self, groups: DataFrame) -> DataFrame:
        """Links between groups that may be left: among documents with a prefix shingle that several groups hold.
        Those with any such shingle of one least holder are a family. A document goes once to each of its families,
        of which small ones share blocks; one of more than a block is searched as pairs of blocks."""
        held = self.prefix.join(grown(groups.select("uid", "group", "chars")), "uid")
        spread = F.min("group") < F.max("group")
        by_several = held.groupBy("shingle").agg(F.min("uid").alias("family"), F.count("*").alias("n"), spread.alias("several")).where("several").drop("several")
        families = self.scratch.write(join_keys(held, by_several, "shingle", self.prefix.count()).select("uid", "group", "chars", "family").distinct())
        sizes = families.groupBy("family", "group").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
        largest = sizes.groupBy("family").agg(
            F.max_by("group", F.struct("n", "group")).alias("largest"), F.max(F.struct("n", "group", "chars")).alias("l"), F.sum("n").alias("n"), F.sum("chars").alias("chars")
        )
        plan = self.scratch.write(
            largest.select(
                "family", "largest", "n", "chars", (_parts(F.col("n"), F.col("chars")) == 1).alias("small"), _parts(F.col("l.n"), F.col("l.chars")).alias("m"),
                F.greatest(F.lit(1), _parts(F.col("n") - F.col("l.n"), F.col("chars") - F.col("l.chars"))).alias("k"),
            )
        )
        shared = plan.where("small").agg(F.sum("n"), F.sum("chars")).first()
        # half full on average, as a family isn't divided
        blocks = max(1, -(-2 * (shared[0] or 0) // BLOCK), -(-2 * (shared[1] or 0) // BLOCK_CHARS))
        rows = families.join(grown(plan.drop("n", "chars")), "family")
        block = -1 - F.pmod(F.xxhash64("family"), F.lit(blocks))
        small = rows.where("small").select("uid", block.alias("family"), F.lit(0).alias("i"), F.lit(0).alias("j")).distinct()
        inside = F.col("group") == F.col("largest")
        large = rows.where("not small").withColumn("mine", F.when(inside, _place(F.col("m"))).otherwise(F.col("m") + _place(F.col("k"))))
        every = F.sequence(F.lit(0), F.col("m") + F.col("k") - 1)
        # two blocks of the largest group hold nothing that could link anew
        others = F.filter(every, lambda x: ~inside | (x >= F.col("m")))
        pairs = F.transform(others, lambda x: F.struct(F.least(x, F.col("mine")).alias("i"), F.greatest(x, F.col("mine")).alias("j")))
        large = large.select("uid", "family", F.explode(pairs).alias("p")).select("uid", "family", "p.i", "p.j")
        # Spark takes exploded rows for no more than those they come from
        rows = small.unionByName(large).join(grown(self.texts), "uid")
        return self.scratch.write(self.search(rows.select("family", "i", "j", "uid", "text"), "family", "i", "j"))


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, textid (hash of the text), n_shingles, component_id (the least doc_id of the group), and
    `leader`: whether the row is the one of its group with the least (doc_id, textid)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    text = text_of(text_col)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("textid"), text.alias("text"))
    wide = scratch.write(_sets(src, words, num, den))
    sets = scratch.write(wide.drop("shingles"))
    classes = scratch.write(
        sets.where("n > 0").groupBy("digest").agg(F.min("uid").alias("class"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "textid")).alias("least"), F.first("n").alias("n"), F.first("lead").alias("lead"))
    )
    # shingles that more than one class holds
    total = (wide.agg(F.sum(F.octet_length("shingles"))).first()[0] or 0) // 8
    shared = shared_shingles(wide.select("uid", "shingles").join(grown(classes.select(F.col("class").alias("uid"))), "uid", "left_semi"), total)
    shared = shared.join(grown(classes.select(F.col("class").alias("uid"), "n", "lead")), "uid")
    # the prefix: shingles that nobody else holds come first among those that lead
    leads = (F.col("shingle") >= 0) & (F.col("shingle") < int(LEADING))
    by_rank = F.struct(~leads, F.when(leads, F.col("held")), F.col("shingle"))
    rank = F.row_number().over(Window.partitionBy("uid").orderBy(by_rank))
    shared = shared.withColumn("alone", F.col("lead") - F.sum(leads.cast("long")).over(Window.partitionBy("uid"))).withColumn("rank", rank)
    length = F.col("n") + F.floor(-num * F.col("n") / den) + 1
    in_prefix = ~leads | (F.col("alone") + F.col("rank") <= length)
    prefix = scratch.write(shared.where(in_prefix).select("uid", "shingle"))
    scratch.drop(wide)
    least = prefix.groupBy("shingle").agg(F.min("uid").alias("b"), F.count("*").alias("n"))
    pairs = join_keys(prefix, least, "shingle", prefix.count()).where("uid != b").select(F.col("uid").alias("a"), "b").distinct()
    clusters = scratch.write(components(pairs, scratch))
    # every clustered document, once, with its text
    members = scratch.write(clusters.join(grown(sets.select(F.col("uid").alias("node"), "doc_id", "textid", "chars")), "node").select(F.col("node").alias("uid"), "root", "chars", "doc_id", "textid"))
    ours = members.select("uid", F.col("doc_id").alias("m_doc"), F.col("textid").alias("m_text"))
    texts = scratch.write(src.join(grown(ours), F.col("doc_id").eqNullSafe(F.col("m_doc")) & (F.col("textid") == F.col("m_text"))).select("uid", "text"))
    links = Clusters(scratch, members.select("uid", "root", "chars"), texts, prefix, words, num, den).links()
    groups = components(links, scratch)
    named = classes.select("digest", "class", "least").join(grown(groups.select(F.col("node").alias("class"), "root")), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = named.groupBy("root").agg(F.min("least").alias("least"))
    named = named.select("digest", "root").join(grown(least), "root").select("digest", F.col("least"))
    out = sets.select("uid", "doc_id", "textid", F.col("n").alias("n_shingles"), "digest").join(grown(named), "digest", "left")
    alone = F.col("least").isNull()
    return out.select(
        "doc_id",
        "textid",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("least")["doc_id"]).alias("component_id"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("least")["doc_id"]) & (F.col("textid") == F.col("least")["textid"]))).alias("leader"),
    )
