"""Filling containers of fixed capacity with texts, sized in tokens.

Pattern packing by non-negative least squares. The driver only sees the
histogram of sizes, at most MAX_SIZES counts for each container kind, however
many items there are. Sizes fall into classes of about equal weight in the histogram, each counted at its
largest member; all patterns of few items whose classes fill a container but for a small slack are
enumerated, non-negative least squares fits how often each is used
so that the histogram is met, and the rounded counts are laid out. What is left
over (the residuals, mainly small items) goes by best fit, largest first, into
the spaces left and then into new containers, again in whole groups of equal
containers instead of item by item. This is done for each of the GRIDS, from
few classes and longer patterns to many classes and short patterns, and the plan
with the fewest containers is taken. Best fit alone is the plan only where it takes fewer than all of them.

The plan says for each size which ranks go to which containers. An item gets its
rank among those of its size from its place in a hash bucket and the counts of
the buckets before it, so no task sees all items of a frequent size, and the
assignment is the same when a task is repeated.
"""

from __future__ import annotations

import bisect
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamizal.session import materialize

#: Numbers of classes, and the most items in a pattern.
GRIDS = ((24, 5), (64, 4), (160, 3))
#: Part of the capacity that a pattern may leave to small items.
SLACK = 64
#: Part of the capacity that may stay free in a container that a pattern lays out with real sizes.
FILL = 128
#: Sizes that a plan tells apart at most; for larger capacities sizes are rounded up to a multiple of a unit, so no container overflows.
MAX_SIZES = 1 << 20
#: Items of one size among which one task gives ranks, on average.
BUCKET_ITEMS = 200_000


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that minimizes |a x - b|, by the active-set method; ends when no column gains any more."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    error = np.linalg.norm(b)
    while True:
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= 1e-9 * max(1.0, np.abs(b).max()):
            return x
        active[best] = True
        before = x.copy()
        while True:
            cols = np.flatnonzero(active)
            z = np.linalg.lstsq(a[:, cols], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[cols] = z
                break
            low = z <= 0
            step = np.min(x[cols][low] / np.maximum(x[cols][low] - z[low], 1e-300))
            x[cols] += step * (z - x[cols])
            drop = cols[(x[cols] <= 1e-12) & low]
            active[drop] = False
            x[drop] = 0
        now = np.linalg.norm(a @ x - b)
        if now >= error * (1 - 1e-12):  # what is left to gain is below the precision of the numbers
            return before if now > error else x
        error = now


def size_classes(histogram: dict[int, int], most: int) -> list[list[int]]:
    """The sizes cut into classes of about equal weight (items times size), largest first in and among them."""
    sizes = sorted(histogram, reverse=True)
    share = sum(s * histogram[s] for s in sizes) / most
    found: list[list[int]] = []
    held = share
    for s in sizes:
        if held >= share:
            found.append([])
            held -= share if held < 2 * share else held
        found[-1].append(s)
        held += s * histogram[s]
    return found


def patterns(tops: list[int], capacity: int, slack: int, few: int) -> list[tuple[int, ...]]:
    """All multisets of 2 to few classes, as their places among tops (falling), whose tops sum up to the capacity less at most slack."""
    found: list[tuple[int, ...]] = []
    rising = [-t for t in tops]

    def extend(left: int, first: int, parts: tuple[int, ...]) -> None:
        if left <= slack and len(parts) > 1:
            found.append(parts)
        more = few - len(parts)
        if more == 1 and parts:  # only classes that fill what is left
            found.extend((*parts, c) for c in range(max(first, bisect.bisect_left(rising, -left)), bisect.bisect_right(rising, slack - left)))
        elif more > 1:
            for c in range(max(first, bisect.bisect_left(rising, -left)), len(tops)):
                if tops[c] * more < left - slack:
                    break
                extend(left - tops[c], c, (*parts, c))

    extend(capacity, 0, ())
    return found


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """The plan of the grid that takes the fewest containers; see plan_on."""
    return min((plan_on(histogram, capacity, *grid) for grid in (*GRIDS, (0, 0))), key=lambda x: x[1])


def plan_on(histogram: dict[int, int], capacity: int, classes: int, few: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Where the items go, and the number of containers.

    Entries are (size, first rank, number of items, first container, items per
    container, whether a pattern put them there): the item of that size and of rank first + i goes to container
    first container + i // items per container.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    ranks: dict[int, int] = defaultdict(int)
    entries: list[tuple[int, int, int, int, int, int]] = []
    spaces: dict[int, list[tuple[int, int]]] = defaultdict(list)
    used = 0

    def place(size: int, count: int, base: int, each: int = 1, by_pattern: int = 0) -> None:
        entries.append((size, ranks[size], count, base, each, by_pattern))
        ranks[size] += count
        left[size] -= count

    members = size_classes(left, classes) if classes else []
    every = patterns([m[0] for m in members], capacity, capacity // SLACK, few)
    if every:
        a = np.zeros((len(members), len(every)))
        for j, p in enumerate(every):
            for c in p:
                a[c, j] += 1
        b = np.array([float(sum(left[s] for s in m)) for m in members])
        fit = nnls(a, b)
        rising = sorted(left)
        for j in np.argsort(-fit, kind="stable"):
            p = every[j]
            repeat = int(fit[j] + 0.5)
            while repeat > 0:
                sizes: list[int] = []
                for c in p[:-1]:
                    sizes += [s for s in members[c] if left[s] - sizes.count(s) > 0][:1]
                room = capacity - sum(sizes)
                # the last place takes the largest item that still fits, from the pattern's class upwards
                at = bisect.bisect_right(rising, room) - 1
                while at >= 0 and left[rising[at]] - sizes.count(rising[at]) <= 0:
                    if left[rising[at]] == 0:
                        rising.pop(at)
                    at -= 1
                if len(sizes) < len(p) - 1 or at < 0 or rising[at] < members[p[-1]][-1]:
                    break
                sizes.append(rising[at])
                room -= rising[at]
                if room > capacity // FILL:  # left to the residuals, which may fill it better
                    break
                many = min([repeat, *(left[s] // sizes.count(s) for s in set(sizes))])
                for s in set(sizes):
                    place(s, many * sizes.count(s), used, sizes.count(s), 1)
                if room:
                    spaces[room].append((used, many))
                used += many
                repeat -= many
    rooms = sorted(spaces)
    for s in sorted(left, reverse=True):
        while left[s] > 0:
            k = bisect.bisect_left(rooms, s)
            if k == len(rooms):
                each = capacity // s
                whole, rest = divmod(left[s], each)
                for many, per in ((whole, each), (1, rest)):
                    if many and per:
                        place(s, many * per, used, per)
                        _free(spaces, rooms, capacity - per * s, used, many)
                        used += many
                continue
            room = rooms[k]
            base, many = spaces[room].pop()
            if not spaces[room]:
                rooms.pop(k)
            take = min(many, left[s])
            place(s, take, base)
            _free(spaces, rooms, room - s, base, take)
            if take < many:
                _free(spaces, rooms, room, base + take, many - take)
    return entries, used


def _free(spaces: dict[int, list[tuple[int, int]]], rooms: list[int], room: int, base: int, many: int) -> None:
    if room > 0:
        if not spaces[room]:
            bisect.insort(rooms, room)
        spaces[room].append((base, many))


def pack(sizes: DataFrame, capacities: DataFrame, key: str = "doc_id", size: str = "tokens", name: str = "window_name", capacity: str = "capacity_tokens") -> DataFrame:
    """Assign every item of sizes to containers of each capacity.

    Result: name, key, part_no, start (first token of the part within its item),
    tokens, container_id, by_pattern. An item is divided only if it alone exceeds the
    capacity: into parts of the whole capacity and one rest. No container holds
    more than its capacity. Containers laid out by patterns have the first ids; by_pattern tells what
    a pattern put where it is. An item of size 0 or null has one row with tokens 0
    and null for both. Repeated rows and null keys are items of their own.
    A null or non-positive capacity gives no rows. Other columns aren't read.
    """
    kinds = [(r[0], int(r[1])) for r in capacities.select(name, capacity).distinct().orderBy(name, capacity).collect() if r[1] is not None and r[1] > 0]
    item = sizes.select(F.col(key).alias("k"), F.coalesce(F.col(size), F.lit(0)).cast("int").alias("n"))
    key_kind = dict(item.dtypes)["k"]
    # as written, a row's number is its own however many rows repeat its key
    item = materialize(item.withColumn("row", F.monotonically_increasing_id()), "sizes")
    spark = sizes.sparkSession
    out_schema = f"w int, k {key_kind}, part_no int, start bigint, tokens int, container_id bigint, by_pattern boolean"
    if not kinds:
        empty = spark.createDataFrame([], out_schema)
        return empty.select(F.lit(None).cast("string").alias(name), F.col("k").alias(key), "part_no", "start", "tokens", "container_id", "by_pattern")
    table = F.array(*(F.struct(F.lit(i).alias("w"), F.lit(c).cast("bigint").alias("c")) for i, (_, c) in enumerate(kinds)))
    each = item.select("row", "k", "n", F.explode(table).alias("x")).select("x.w", "x.c", "row", "k", "n")
    last = F.greatest(F.ceil(F.col("n") / F.col("c")).cast("int") - 1, F.lit(0))
    parts = each.select("w", "row", "k", "c", "n", F.explode(F.sequence(F.lit(0), last)).alias("part_no"))
    buckets = max(8, math.ceil(item.count() / BUCKET_ITEMS))
    unit = F.ceil(F.col("c") / MAX_SIZES)
    tokens = F.least(F.col("c"), F.col("n") - F.col("part_no") * F.col("c")).cast("int")
    parts = parts.select("w", "row", "k", "part_no", F.pmod(F.xxhash64("row", "part_no"), F.lit(buckets)).cast("int").alias("bucket"), (F.col("part_no") * F.col("c")).alias("start"), tokens.alias("tokens"), "c", unit.alias("unit"))
    # what the plan counts: whole units, an item of more than the units of a container fills one alone
    planned = F.least(F.ceil(F.col("tokens") / F.col("unit")), F.floor(F.col("c") / F.col("unit"))).cast("int")
    parts = parts.withColumn("size", planned).drop("c", "unit")
    counts = materialize(parts.where("tokens > 0").groupBy("w", "size", "bucket").agg(F.count("*").alias("items")), "counts")
    histograms: dict[int, dict[int, int]] = defaultdict(dict)
    for r in counts.groupBy("w", "size").agg(F.sum("items").alias("items")).collect():  # at most MAX_SIZES for each kind
        histograms[r["w"]][r["size"]] = r["items"]
    rows = []
    for w, own in histograms.items():
        rows += [(w, *e) for e in plan(own, kinds[w][1] // math.ceil(kinds[w][1] / MAX_SIZES))[0]]
    rows.sort()
    steps = np.array(rows, dtype=np.int64).reshape(-1, 7)
    before = counts.withColumn("before", F.sum("items").over(Window.partitionBy("w", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = parts.withColumn("at", F.row_number().over(Window.partitionBy("w", "size", "bucket").orderBy("row", "part_no")) - 1)
    ranked = ranked.join(before.select("w", "size", "bucket", F.coalesce("before", F.lit(0)).alias("before")), ["w", "size", "bucket"], "left")
    ranked = ranked.select("w", "k", "part_no", "start", "tokens", "size", (F.col("at") + F.col("before")).cast("bigint").alias("rank"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one number that orders entries by kind of container and size
        code = (steps[:, 0] << 32) | steps[:, 1]
        groups, first = np.unique(code, return_index=True)
        last = np.append(first[1:], len(code))
        for batch in batches:
            w, size = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("w", "size"))
            rank = batch.column("rank").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            mine = (w << 32) | size
            found, laid = np.full(len(mine), -1, dtype=np.int64), np.zeros(len(mine), dtype=bool)
            order = np.argsort(mine, kind="stable")
            own, begin = np.unique(mine[order], return_index=True)
            for g, rows_of in zip(own, np.split(order, begin[1:])):
                at = np.searchsorted(groups, g)
                if at == len(groups) or groups[at] != g or g & 0xFFFFFFFF == 0:
                    continue
                part = steps[first[at] : last[at]]
                e = part[np.searchsorted(part[:, 2], rank[rows_of], side="right") - 1]
                found[rows_of] = e[:, 4] + (rank[rows_of] - e[:, 2]) // e[:, 5]
                laid[rows_of] = e[:, 6] == 1
            none = found < 0
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("w", "k", "part_no", "start", "tokens")), pa.array(found, mask=none), pa.array(laid, mask=none)], names=["w", "k", "part_no", "start", "tokens", "container_id", "by_pattern"])

    names = F.element_at(F.array(*(F.lit(n) for n, _ in kinds)), F.col("w") + 1)
    return ranked.mapInArrow(assign, out_schema).select(names.alias(name), F.col("k").alias(key), "part_no", "start", "tokens", "container_id", "by_pattern")


def summary(packed: DataFrame, capacities: DataFrame, name: str = "window_name", capacity: str = "capacity_tokens") -> DataFrame:
    """Of each kind of container: containers, those laid out by patterns and the rest, tokens, the fewest containers that could hold them, and the share of space used."""
    patterned = F.coalesce(F.max(F.when(F.col("by_pattern"), F.col("container_id"))) + 1, F.lit(0))
    used = packed.where("container_id is not null").groupBy(name).agg((F.max("container_id") + 1).alias("containers"), patterned.alias("by_pattern"), F.sum("tokens").alias("tokens"))
    return used.join(F.broadcast(capacities.select(name, capacity)), name).select(
        name, "containers", "by_pattern", (F.col("containers") - F.col("by_pattern")).alias("residual"), "tokens", F.ceil(F.col("tokens") / F.col(capacity)).alias("fewest"),
        F.round(F.col("tokens") / (F.col("containers") * F.col(capacity)), 4).alias("share_used"),
    )


def audit(packed: DataFrame, sizes: DataFrame, capacities: DataFrame, key: str = "doc_id", size: str = "tokens", name: str = "window_name", capacity: str = "capacity_tokens") -> DataFrame:
    """Of each kind of container: items, tokens of all items, tokens in containers, and how many containers overflow or items are divided though they fit."""
    used = packed.where("container_id is not null")
    limit = F.broadcast(capacities.select(name, F.col(capacity).alias("limit")))
    full = used.groupBy(name, "container_id").agg(F.sum("tokens").alias("held")).join(limit, name).groupBy(name).agg(F.sum((F.col("held") > F.col("limit")).cast("int")).alias("overflowing"), F.sum("held").alias("held"))
    cut = used.join(limit, name).where("part_no > 0").join(sizes.select(key, F.col(size).alias("whole")), key).groupBy(name).agg(F.sum((F.col("whole") <= F.col("limit")).cast("int")).alias("divided"))
    whole = sizes.agg(F.count("*").alias("items"), F.sum(size).alias("whole"))
    return limit.crossJoin(F.broadcast(whole)).join(full, name, "left").join(cut, name, "left").select(name, "items", F.col("whole").alias("tokens"), F.coalesce("held", F.lit(0)).alias("held"), F.coalesce("overflowing", F.lit(0)).alias("overflowing"), F.coalesce("divided", F.lit(0)).alias("divided"))
