"""Mixing sources to target weights, by Poisson replication.

Every document gets a uniform number from a hash of its id and a seed. Its count is the inverse of
the Poisson distribution with the source's rate at that number, capped at the source's
``max_repeats``; so counts need no state, are the same wherever they are computed, and grow with the
rate. The rate of a source is its target repetition, the share of the total size divided by what the
source has; where the cap or the chance of few documents moves the realised size off the target, the
rate is corrected. The realised size at any rate follows from how much of the source stands above each
step of the distribution. So one aggregation gives the driver the size by source and bin of the uniform
number, which is enough for the rate to one part in ``BINS``; a second one splits only the bins that a
step falls into, once more by ``BINS``, and the rate is found again on both by bisection, as realised
sizes never fall when a rate rises. The driver holds at most ``BINS`` numbers a source, and as many a step.

The total is the greatest at which no source needs more than ``use`` of what its cap allows, so the
scarcest source sets it. Documents are exploded by their count and shuffled globally, by sorting on
a hash of id, copy and seed.

Texts sent again under another id are one document: the smallest id is used, so no text exceeds the
cap. Sources are matched in lower case with spaces and hyphens as underscores. Documents of other or
null sources, null or empty texts (size 0) and sources with a share of 0 are not chosen. A target
source without documents gets the share 0 and the rest keep their proportions. ``target_met`` says for
each source whether its size is within ``TOLERANCE`` of the wanted one and one document of the source, as
documents are used whole; a source without documents doesn't meet its target.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.runtime import materialize, small

#: Bins of the uniform number; sources at most; the greatest relative difference of a size that counts as met.
BINS, MAX_SOURCES, TOLERANCE = 1024, 1000, 0.005


def plain_source(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"[\s\xa0]+", " "))), "[ -]+", "_")


def uniform(seed: int, *cols: str) -> Column:
    """A number in (0, 1) from a hash: 52 bits of it, and a half."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 12).cast("double") + 0.5) / F.lit(float(1 << 52))


def poisson_steps(rate: float, cap: int) -> list[float]:
    """P(X <= k) for k = 0 .. cap - 1 of a Poisson distribution: u beyond the k-th of them is a count over k."""
    out, p, total = [], math.exp(-rate), 0.0
    for k in range(cap):
        total += p
        out.append(total)
        p *= rate / (k + 1)
    return out


def counts_of(rates: dict[str, tuple[float, int]]) -> Column:
    """The capped Poisson count of a row by its columns source and u; rates: source -> (rate, cap)."""
    table = F.create_map(*[x for s, (rate, cap) in rates.items() for x in (F.lit(s), F.array(*[F.lit(v) for v in poisson_steps(rate, cap)]))])
    return F.size(F.filter(table[F.col("source")], lambda step: step < F.col("u")))


def choose(documents: DataFrame, doc: str, text: str, source: str, size: Column, targets: DataFrame, seed: int = 7, use: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares).

    chosen: (doc, source, size, n_used) of every document used at least once. shares: one row per
    target source with its target and reached share, sizes, documents and greatest count.
    targets: (source, target_share, max_repeats), a small table; a repeated source counts once.
    """
    goal = {r[0]: (float(r[1]), int(r[2])) for r in small(targets.select(plain_source("source"), "target_share", "max_repeats").dropna(), MAX_SOURCES) if r[1] > 0 and r[2] > 0}
    wanted = documents.select(F.col(doc).alias("doc"), plain_source(source).alias("source"), F.col(text).alias("text")).where(F.col("source").isin(list(goal)) & (F.length("text") > 0))
    first = wanted.groupBy(F.xxhash64("text").alias("h"), F.md5("text").alias("m")).agg(F.min(F.struct("doc", "source")).alias("d"))
    kept = first.select("d.doc", "d.source")
    # Sizes are counted where the text is, so the texts themselves aren't shuffled.
    sizes = wanted.select("doc", size.alias("size"))
    docs = materialize(kept.join(sizes, "doc").where("size > 0").withColumn("u", uniform(seed, "doc")).select("doc", "source", "size", "u"), "sized")
    sums = {r[0]: (int(r[1]), int(r[2])) for r in docs.groupBy("source").agg(F.sum("size"), F.max("size")).collect()}  # one row a source
    have = {s: v[0] for s, v in sums.items()}
    goal = {s: g for s, g in goal.items() if s in have}
    if not goal:
        none = docs.where("false")
        return none.select("doc", "source", "size", F.lit(0).alias("n_used")), _shares(none.withColumn("n_used", F.lit(0)), targets, {})
    all_shares = sum(g[0] for g in goal.values())
    share = {s: g[0] / all_shares for s, g in goal.items()}
    total = min(use * have[s] * goal[s][1] / share[s] for s in goal)
    want = {s: share[s] * total for s in goal}
    rates = {s: (_calibrated(coarse, want[s], goal[s][1]), goal[s][1]) for s, coarse in _histograms(docs, {}).items() if s in goal}
    # With their neighbours, as the second calibration may move a step a little.
    edges = {s: sorted({b for x in poisson_steps(*rate) for b in range(int(x * BINS) - 1, int(x * BINS) + 2) if 0 <= b < BINS}) for s, rate in rates.items()}
    fine = _histograms(docs, edges)
    rates = {s: (_calibrated(fine[s], want[s], cap), cap) for s, (_, cap) in rates.items()}
    chosen = docs.withColumn("n_used", counts_of(rates)).where("n_used > 0").select("doc", "source", "size", "n_used")
    return chosen, _shares(chosen, targets, {s: (w, sums[s][1]) for s, w in want.items()})


def _histograms(docs: DataFrame, split: dict[str, list[int]]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Of each source the upper ends of its bins of u, ascending, and the size in each; bins in split are split once more."""
    at = F.floor(F.col("u") * BINS)
    sub = F.lit(0).cast("long")
    if split:
        inside = F.create_map(*[x for s, bins in split.items() for x in (F.lit(s), F.array(*[F.lit(b).cast("long") for b in bins]))])[F.col("source")]
        sub = F.when(F.array_contains(inside, at), F.floor((F.col("u") * BINS - at) * BINS) + 1).otherwise(0)
    rows = docs.groupBy("source", at.alias("at"), sub.alias("sub")).agg(F.sum("size").alias("size")).collect()  # at most BINS a source, and BINS a split bin
    out: dict[str, list[tuple[float, int]]] = {}
    for r in rows:
        out.setdefault(r["source"], []).append(((r["at"] + (r["sub"] / BINS if r["sub"] else 1)) / BINS, int(r["size"])))
    return {s: tuple(np.array(c) for c in zip(*sorted(v))) for s, v in out.items()}


def _calibrated(histogram: tuple[np.ndarray, np.ndarray], want: float, cap: int) -> float:
    """The rate at which the capped counts of the histogram's documents sum up to about want."""
    ends, sizes = histogram
    above = np.concatenate([np.cumsum(sizes[::-1])[::-1], [0]])

    def realised(rate: float) -> float:
        return float(sum(above[np.searchsorted(ends, step, side="right")] for step in poisson_steps(rate, cap)))

    def least(test: Callable[[float], bool]) -> float:
        lo, hi = 0.0, 700.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if test(realised(mid)) else (mid, hi)
        return hi

    enough = least(lambda got: got >= want)
    over, under = realised(enough), realised(enough * (1 - 1e-9))
    best = over if over - want <= want - under else under
    # The middle of all rates that give it, as a document's number is only known to the width of its bin.
    return (least(lambda got: got >= best) + least(lambda got: got > best)) / 2


def _shares(chosen: DataFrame, targets: DataFrame, wanted: dict[str, tuple[float, int]]) -> DataFrame:
    """wanted: the size that each source should contribute, and its largest document."""
    got = chosen.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n_used")).alias("used_size"), F.count("*").alias("n_documents"), F.max("n_used").alias("most_used")
    )
    whole = got.agg(F.sum("used_size").alias("whole"))
    want = targets.groupBy(plain_source("source").alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    goals = chosen.sparkSession.createDataFrame([(s, float(w), n) for s, (w, n) in wanted.items()], "source string, wanted_size double, largest long")
    met = F.abs(F.coalesce("used_size", F.lit(0)) - F.col("wanted_size")) <= F.col("wanted_size") * TOLERANCE + F.col("largest")
    return (
        want.join(got, "source", "left")
        .join(F.broadcast(goals), "source", "left")  # at most MAX_SOURCES rows
        .crossJoin(F.broadcast(whole))  # one row
        .select(
            "source",
            "target_share",
            F.coalesce(F.col("used_size") / F.col("whole"), F.lit(0.0)).alias("reached_share"),
            F.coalesce("used_size", F.lit(0)).alias("used_size"),
            F.coalesce("n_documents", F.lit(0)).alias("n_documents"),
            F.coalesce("most_used", F.lit(0)).alias("most_used"),
            "max_repeats",
            F.coalesce(met, F.col("target_share") <= 0).alias("target_met"),
        )
    )


def mixture(chosen: DataFrame, seed: int = 7) -> DataFrame:
    """(doc, source, size, copy_no): every copy, in the global shuffled order."""
    copies = chosen.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n_used"))))
    return copies.orderBy(F.xxhash64(F.lit(seed + 1), "doc", "copy_no"), "doc", "copy_no").select("doc", "source", "size", "copy_no")
