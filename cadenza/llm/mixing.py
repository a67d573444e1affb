"""Mixing of sources to target weights, by min-cost flow over membership patterns.

Documents may belong to several sources. They are aggregated by membership pattern; token capacity flows
from the patterns to the sources' quotas, where each further repetition of a pattern costs more than the
one before (convex costs), so that nothing is repeated while something fresh would do. Only the patterns
reach the driver; their number is bounded by the sources and is checked. The documents that carry a
pattern's flow are then selected in a seeded order, by histograms of that order: whole buckets while they fit,
the bucket that doesn't is divided again until it holds ZONE documents at most, and only those, without their
texts, are decided one by one.

Defined results: null text has size 0; a null source is a source of its own, the last; an empty membership
takes no part; documents of size 0 take 0; an empty table gives no rows; repeated rows are documents of
their own with one common place in the order, where a running number tells them apart (which of equal documents is
taken makes no difference). The selection depends on the seed and the rows alone, not on partitions; a text of
any length counts by its words.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import Scratch, text_of, words_of

#: Bits of the seeded order that a histogram divides its bucket by.
STEP = 12
#: Documents after the last bucket that is taken whole, among which the rest is filled up.
ZONE = 1024
#: Rows of zones that are broadcast; more are joined.
BROADCAST_ROWS = 1 << 18
#: Patterns that the flow is solved for on the driver.
MAX_PATTERNS = 200_000
WEIGHTS = (3, 1, 2)
REPEATS = 2


def targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """What each source should give: `share` of all sizes by weight, no source above `most` times its size;
    what that leaves over is shared again by weight among the others."""
    out = [0.0] * len(sizes)
    left, open_ = share * sum(sizes), [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        unit = left / sum(weights[i] for i in open_)
        above = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not above:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in above:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(above)]
        left = max(left, 0.0)
    return out


def min_cost_flow(capacity: dict[tuple[int, ...], int], quota: list[int], repeats: int) -> dict[tuple[int, ...], dict[int, int]]:
    """Units that go from each pattern to each of its sources: as many as the quotas ask for, at the least
    cost. The k-th use of a unit of a pattern costs k * k. Successive shortest paths over the residual
    network pattern -> source; patterns that hold one source only need no path of length over one."""
    flow: dict[tuple[int, ...], dict[int, int]] = {p: dict.fromkeys(p, 0) for p in capacity}
    used = dict.fromkeys(capacity, 0)
    need = list(quota)
    holders: dict[int, list[tuple[int, ...]]] = {}
    for p in sorted(capacity):
        for s in p:
            holders.setdefault(s, []).append(p)

    def layer(p: tuple[int, ...]) -> tuple[int, int] | None:
        """Cost and room of the cheapest use of a pattern that is still free."""
        if not capacity[p] or used[p] >= repeats * capacity[p]:
            return None
        k = used[p] // capacity[p] + 1
        return k * k, k * capacity[p] - used[p]

    # from each source that lacks something, back over patterns, to the cheapest room: Dijkstra with costs
    # that arise at the patterns only (moving a unit from one source to another costs nothing)
    for s in range(len(need)):
        while need[s] > 0:
            seen: dict[int, tuple[int, tuple[int, ...]] | None] = {s: None}
            queue, best = [s], None
            for at in queue:
                for p in holders.get(at, ()):
                    if (room := layer(p)) and (best is None or (room[0], len(p), p) < best[0]):
                        best = ((room[0], len(p), p), at, room[1])
                    for other in p:  # `other` can take its unit elsewhere and leave this pattern's to `at`
                        if other not in seen and flow[p][other] > 0:
                            seen[other] = (at, p)
                            queue.append(other)
            if best is None:
                break
            (_, _, p), at, room = best
            amount, back, path = min(need[s], room), at, []
            while seen[back] is not None:
                to, via = seen[back]
                path.append((to, via, back))
                amount = min(amount, flow[via][back])
                back = to
            flow[p][at] += amount
            used[p] += amount
            for to, via, gave in path:
                flow[via][gave] -= amount
                flow[via][to] += amount
            need[s] -= amount
    return flow


def _seeded(seed: int, *parts: str) -> Column:
    """A place in the order that depends on the seed and the columns alone, as a non-negative long."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *map(F.col, parts)), 1)


def _fill(zone: pa.Table) -> pa.Table:
    """A pattern's zone: in the seeded order, every document that still fits is used once more; a last one
    that doesn't fit is used if that comes nearer."""
    zone = zone.take(pc.sort_indices(zone, [(k, "ascending") for k in ("order", "tie", "uid")]))
    left = zone["left"][0].as_py()
    sizes, used = zone["size"].to_pylist(), []
    for n in sizes:
        used.append(int(n <= left))
        left -= n if n <= left else 0
    over = [(n, i) for i, n in enumerate(sizes) if not used[i]]
    if over and min(over)[0] < 2 * left:
        used[min(over)[1]] = 1
    return pa.table({"uid": zone["uid"], "more": pa.array(used, pa.int64())})


def _zones(rows: DataFrame, parts: dict[int, int]) -> list[tuple[int, int, int, int, int, int]]:
    """For each plan the zone in the order: (plan, left, first order, first tie, last order, last tie), where `left`
    of its words are still to be taken after all documents before the zone. rows: plan, order, tie, size."""
    #: plan -> (words before the bucket that is divided, the bits that lead to it)
    open_, zones, bits = {p: (0, 0) for p in parts}, [], 126
    while open_ and bits:
        # the order's 63 bits first, then those that tell equal documents apart
        column, above = ("order", bits - 63) if bits > 63 else ("tie", bits)
        below = max(0, above - STEP)
        edges = [(p, prefix >> 63 if column == "tie" else 0, prefix & ((1 << 63) - 1) if column == "tie" else prefix) for p, (_, prefix) in open_.items()]
        led = F.broadcast(rows.sparkSession.createDataFrame(edges, "plan int, of_order long, prefix long"))  # a row for each plan
        inside = rows.join(led, "plan").where((F.shiftright(column, above) if above < 63 else F.lit(0).cast("long")) == F.col("prefix"))
        if column == "tie":
            inside = inside.where(F.col("order") == F.col("of_order"))
        bucket = F.shiftright(column, below).bitwiseAND(F.lit((1 << (above - below)) - 1))
        hist = inside.groupBy("plan", bucket.alias("bucket")).agg(F.sum("size").alias("n"), F.count("*").alias("docs"))
        part = rows.sparkSession.createDataFrame([(p, parts[p] - before) for p, (before, _) in open_.items()], "plan int, part long")
        along = Window.partitionBy("plan").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hist = hist.join(F.broadcast(part), "plan").withColumn("until", F.sum("n").over(along)).withColumn("docs_until", F.sum("docs").over(along))
        after = hist.where("until > part")
        edge = after.groupBy("plan").agg(F.min(F.struct("bucket", "until", "n", "docs", "docs_until")).alias("e"))
        within = (F.col("bucket") == F.col("e.bucket")) | (F.col("docs_until") - F.col("e.docs_until") + F.col("e.docs") <= ZONE)
        found = after.join(F.broadcast(edge), "plan").groupBy("plan", "e").agg(F.max(F.when(within, F.col("bucket"))).alias("last"))
        bits -= above - below
        further = {}
        for r in found.collect():
            before, prefix = open_[r.plan]
            taken = before + r.e.until - r.e.n
            first, last = (prefix << (above - below)) + r.e.bucket, (prefix << (above - below)) + r["last"]
            if r.e.docs > ZONE and bits:
                further[r.plan] = (taken, first)
            else:
                low, high = first << bits, ((last + 1) << bits) - 1
                zones.append((r.plan, parts[r.plan] - taken, low >> 63, low & ((1 << 63) - 1), high >> 63, high & ((1 << 63) - 1)))
        open_ = further
    return zones


def mix(docs: DataFrame, sources: Column, share: float = 1.5, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, sources, the first source's source_size and target, copies and taken, for each row.

    `sources`: array of the sources that a document belongs to. `carry`: columns of `docs` to keep."""
    spark = docs.sparkSession
    words = words_of(text_of(text_col))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(text_of(text_col)).alias("digest"),
        F.size(words).cast("long").alias("size"),
        F.array_sort(F.array_distinct(F.transform(sources, lambda x: F.struct(x.isNull().alias("last"), x.cast("string").alias("name"))))).alias("pattern"),
        F.monotonically_increasing_id().alias("uid"),
        *([F.struct(*carry).alias("__carry")] if carry else []),
    )
    rows = Scratch(spark, "mixing").write(rows)  # the texts are read once, and the running numbers stay
    by_pattern = rows.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(by_pattern) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns of sources")
    names = sorted({(s["last"], s["name"]) for r in by_pattern for s in r.pattern or ()}, key=lambda s: (s[0], s[1] or ""))
    place = {n: i for i, n in enumerate(names)}
    capacity = {tuple(place[(s["last"], s["name"])] for s in r.pattern): r["size"] for r in by_pattern if r.pattern}
    sizes = [0] * len(names)
    for p, n in capacity.items():
        for s in p:
            sizes[s] += n
    total = sum(capacity.values())
    own = [weights[i % len(weights)] for i in range(len(names))]
    overlap = total / sum(sizes) if sum(sizes) else 1.0
    goal = targets(sizes, own, share * overlap, repeats)
    flow = min_cost_flow(capacity, [round(g) for g in goal], repeats)

    # a pattern's plan: `whole` uses of all its documents, and `part` words more from the first in the order
    plan = []
    for i, r in enumerate(by_pattern):
        p = tuple(place[(s["last"], s["name"])] for s in r.pattern or ())
        f = sum(flow[p].values()) if p else 0
        n = capacity.get(p, 0)
        plan.append((i, r.pattern, sizes[p[0]] if p else 0, goal[p[0]] if p else 0.0, f // n if n else 0, f % n if n else 0))
    kind = rows.schema["pattern"].dataType.simpleString()
    plans = F.broadcast(spark.createDataFrame(plan, f"plan int, pattern {kind}, source_size long, target double, whole long, part long"))
    rows = rows.join(plans, rows["pattern"].eqNullSafe(plans["pattern"]), "left").drop(plans["pattern"])
    rows = rows.withColumn("order", _seeded(seed, "doc_id", "digest")).withColumn("tie", _seeded(seed, "uid"))
    # along the order, everything before the zone is taken once more; the zone is decided by document
    zones = _zones(rows.where("part > 0").select("plan", "order", "tie", "size"), {i: part for i, *_, part in plan if part})
    zone = F.broadcast(spark.createDataFrame(zones, "plan int, left long, o1 long, t1 long, o2 long, t2 long"))  # a row for each plan
    rows = rows.join(zone, "plan", "left")
    at, low, high = F.struct("order", "tie"), F.struct(F.col("o1").alias("order"), F.col("t1").alias("tie")), F.struct(F.col("o2").alias("order"), F.col("t2").alias("tie"))
    decided = rows.where(F.col("left").isNotNull() & (at >= low) & (at <= high)).select("plan", "uid", "order", "tie", "size", "left")
    used = decided.groupBy("plan").applyInArrow(_fill, "uid long, more long")
    out = rows.join(F.broadcast(used) if len(zones) * ZONE <= BROADCAST_ROWS else used, "uid", "left")
    once_more = F.coalesce(F.col("more"), F.when(F.col("left").isNotNull() & (at < low), 1).otherwise(0))
    out = out.withColumn("copies", F.col("whole") + once_more)
    copies = F.coalesce(F.col("copies"), F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        "size",
        F.transform("pattern", lambda s: s["name"]).alias("sources"),
        F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"),
        F.coalesce("target", F.lit(0.0)).alias("target"),
        (copies * F.col("size")).alias("taken"),
        copies.alias("copies"),
        *(F.col("__carry")[c].alias(c) for c in carry),
    )
