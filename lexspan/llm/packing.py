"""Filling fixed-capacity containers with items, by non-negative least squares on the histogram.

Sizes are whole numbers from 1 to the capacity, so however many items there are, the histogram of
sizes has at most ``capacity`` counts. On it the plan is made: combinations of up to ``depth``
sizes that fill a container to within ``window`` are enumerated; non-negative least squares finds
how often to repeat each so that their sizes match the histogram; repeats are rounded down to what
the histogram holds, and the residual counts are packed greedily, largest first, each container
taking the largest size that still fits. The plan says for each size which of its items, by rank,
go to which container. Ranks are given without gathering a size's items in one place: items are
counted by (size, salt), the counts summed up, and only a salt's items are numbered together.

An item larger than the capacity is cut into full containers and one rest that is packed as an item.
Items of size 0 and null sizes occupy nothing and are in no container. No other item is left out.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspan.runtime import materialize

#: Rows of one (size, salt) that are numbered together, at most about; a fixed bound of a task's group.
ROWS_PER_SALT = 100_000


def combinations(have: np.ndarray, capacity: int, window: int, depth: int, keep: int = 4000) -> list[tuple[int, ...]]:
    """Combinations of at most depth sizes with a sum in [capacity - window, capacity].

    have: counts by size. For each largest size and depth the last size is looked up among those that
    complete the sum; inner sizes go over a spread of the sizes there are, so the list stays shallow.
    keep bounds the plan, not the items: what no combination takes is packed greedily.
    """
    sizes = np.flatnonzero(have)
    sizes = sizes[sizes > 0]
    out: dict[tuple[int, ...], None] = {}
    for s in sizes[::-1]:
        if s >= capacity - window:
            out[(int(s),)] = None
    spread = sizes[np.unique(np.linspace(0, len(sizes) - 1, min(len(sizes), 40)).astype(int))] if len(sizes) else sizes

    def complete(start: tuple[int, ...], left: int) -> None:
        lo, hi = np.searchsorted(sizes, [max(1, left - window), left + 1])
        if lo < hi:
            best = sizes[lo:hi][np.argmax(have[sizes[lo:hi]] * (1.0 + (sizes[lo:hi] == left)))]
            out[tuple(sorted((*start, int(best)), reverse=True))] = None

    for s in sizes[::-1]:
        if s < capacity:
            complete((int(s),), capacity - int(s))
    starts: list[tuple[int, ...]] = [(int(s),) for s in sizes[::-1]]
    for _ in range(depth - 2):
        longer = []
        for start in starts:
            room = capacity - sum(start)
            for s in spread:
                if s <= start[-1] and s < room:
                    longer.append((*start, int(s)))
        longer = longer[:: max(1, len(longer) // keep)]
        for start in longer:
            complete(start, capacity - sum(start))
        starts = longer
    return list(out)


def nnls(columns: list[tuple[int, ...]], target: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """x >= 0 that makes |A x - target| small, A's columns being the counts of sizes; by coordinate descent."""
    x = np.zeros(len(columns))
    rest = target.astype(float).copy()
    parts = []
    for c in columns:
        k = Counter(c)
        parts.append((np.fromiter(k, int), np.fromiter(k.values(), float)))
    norms = [float((n * n).sum()) for _, n in parts]
    for _ in range(sweeps):
        moved = 0.0
        for j, (at, n) in enumerate(parts):
            new = max(0.0, x[j] + float((rest[at] * n).sum()) / norms[j])
            if new != x[j]:
                rest[at] -= (new - x[j]) * n
                moved = max(moved, abs(new - x[j]))
                x[j] = new
        if moved < 0.01:
            break
    return x


def plan(counts: dict[int, int], capacity: int, window: int = 16, depth: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """[(sizes of a container, number of such containers)] that together use exactly the counts."""
    have = np.zeros(capacity + 1, np.int64)
    for s, n in counts.items():
        have[s] = n
    out: list[tuple[tuple[int, ...], int]] = []

    def take(combo: tuple[int, ...], times: int) -> None:
        for s, k in Counter(combo).items():
            have[s] -= k * times
        out.append((combo, times))

    combos = combinations(have, capacity, window, depth)
    x = nnls(combos, have)
    for j in np.argsort(-x, kind="stable"):
        times = min([int(x[j] + 1e-9)] + [int(have[s]) // k for s, k in Counter(combos[j]).items()])
        if times > 0:
            take(combos[j], times)
    while True:  # greedy rest: one combination at a time, repeated as often as the counts allow
        at = np.flatnonzero(have[1:])
        if not len(at):
            return out
        left, combo, used = capacity, [], Counter()
        while left > 0:
            fit = np.flatnonzero(have[1 : left + 1] - np.fromiter((used[s] for s in range(1, left + 1)), int, left) > 0)
            if not len(fit):
                break
            s = int(fit[-1]) + 1
            combo.append(s)
            used[s] += 1
            left -= s
        take(tuple(combo), min(int(have[s]) // k for s, k in used.items()))


def pack(items: DataFrame, item: str, size: str, capacity: int, window: int = 16, depth: int = 3) -> DataFrame:
    """(container_id, item, part_no, part_start, part_size): where every part of every item goes.

    part_start is the offset of the part in its item. Parts of one item only differ from the item
    where it exceeds the capacity. container_id runs from 0 without gaps; the result is the same for
    the same items.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    sized = materialize(items.select(F.col(item).alias("item"), F.col(size).cast("long").alias("size")).where("size > 0"), "sized")
    spark = items.sparkSession
    whole = F.floor((F.col("size") - 1) / capacity)  # full containers before the last part
    rest = sized.select("item", whole.alias("part_no"), (F.col("size") - whole * capacity).cast("int").alias("part_size"))
    per_size = {r[0]: r[1] for r in rest.groupBy("part_size").count().collect()}  # at most capacity rows
    salts = max(1, -(-max(per_size.values(), default=0) // ROWS_PER_SALT))
    salted = rest.withColumn("salt", F.pmod(F.xxhash64("item", "part_no"), F.lit(salts)))
    before = Window.partitionBy("part_size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("part_size", "salt").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    ranked = (
        salted.withColumn("n", F.row_number().over(Window.partitionBy("part_size", "salt").orderBy("item", "part_no")) - 1)
        .join(offsets, ["part_size", "salt"])
        .select("item", "part_no", "part_size", (F.col("n") + F.col("base")).alias("rank"))
    )
    slots: dict[int, list[tuple[int, int]]] = {}  # size -> [(first rank, first container)], ranks ascending
    used: Counter = Counter()
    first = 0
    for combo, times in plan(per_size, capacity, window, depth):
        for s in combo:
            slots.setdefault(s, []).append((used[s], first))
            used[s] += times
        first += times
    tables = {s: (np.array([a for a, _ in v], np.int64), np.array([c for _, c in v], np.int64)) for s, v in slots.items()}

    @F.pandas_udf("long")
    def container(sizes: pd.Series, ranks: pd.Series) -> pd.Series:
        out = np.empty(len(sizes), np.int64)
        s, r = sizes.to_numpy(), ranks.to_numpy()
        for one in np.unique(s):
            m = s == one
            a, c = tables[int(one)]
            k = np.searchsorted(a, r[m], side="right") - 1
            out[m] = c[k] + r[m] - a[k]
        return pd.Series(out)

    placed = ranked.select(container("part_size", "rank").alias("container_id"), "item", F.col("part_no").cast("int").alias("part_no"), (F.col("part_no") * capacity).alias("part_start"), "part_size")
    # Full parts of items over the capacity are containers of their own, numbered after the planned ones.
    big = sized.where(F.col("size") > capacity).withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(max(salts, 16))))
    fulls = big.groupBy("salt").agg(F.sum(whole).alias("fulls"))
    base = {r["salt"]: r["fulls"] for r in fulls.collect()}  # one row per salt
    start, at = {}, first
    for s in sorted(base):
        start[s] = at
        at += int(base[s])
    starts = spark.createDataFrame([(s, v) for s, v in start.items()], "salt long, start long")
    order = Window.partitionBy("salt").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        big.join(starts, "salt")
        .withColumn("start", F.col("start") + F.coalesce(F.sum(whole).over(order), F.lit(0)))
        .select("item", "start", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)).alias("part_no"))
        .select((F.col("start") + F.col("part_no")).cast("long").alias("container_id"), "item", F.col("part_no").cast("int").alias("part_no"), (F.col("part_no") * capacity).alias("part_start"), F.lit(capacity).alias("part_size"))
    )
    return placed.union(cut)


def containers(placed: DataFrame, capacity: int) -> DataFrame:
    """One row per container: its parts, at most capacity of them, its fill and its unused space."""
    part = F.struct("item", "part_no", "part_start", "part_size")
    return placed.groupBy("container_id").agg(
        F.array_sort(F.collect_list(part)).alias("parts"),
        F.sum("part_size").alias("fill"),
        (F.lit(capacity) - F.sum("part_size")).alias("unused"),
    )
