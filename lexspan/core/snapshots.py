"""What changed between full snapshots, by subtracting invertible Bloom lookup tables.

The rows of each snapshot are reduced to one per key, and each to a pair of a key hash and a hash of
its values (``delivery_pairs``). Pairs fall into buckets by key hash; a bucket of a snapshot is
summarised as a table of ``cells`` cells, each pair entering three of them with a count and exclusive
ors of its hashes (``delivery_tables``). The tables of a delivery are written once; a later delivery is
compared with them alone, not with the rows they were made of. The tables of consecutive snapshots
are subtracted cell by cell, which leaves only the pairs that differ, and these are peeled from the
cells that hold a single one; the digest of all pairs of a bucket verifies what was recovered
(``differences``). A bucket that can't be peeled (too many differences) is built again with four times
as many cells, ``ROUNDS`` times at most, and then its pairs are compared one by one. The recovered
pairs name the rows they come from, which give the keys: a key with a new pair only was added, with
an old one only removed, with both changed.

Pairs are shuffled once, by bucket, to build the tables; no bucket is hot, as its pairs are distinct
keys that a hash spread. What a bucket's peeling holds is bounded by its number of cells.
"""

from __future__ import annotations

import math

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.runtime import drop_table_files, materialize

#: Keys that a bucket holds on average, its cells at first (enough where a fifth of the keys change), and how often they are enlarged; all fixed, so that a bucket's work is bounded.
KEYS_PER_BUCKET, CELLS, ROUNDS = 512, 288, 3


def latest_rows(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """One row per keys: the one with the greatest ``at``; ties by the greatest of all its values.

    Null times come last. The other columns are kept. A hot key is combined on the map side.
    """
    rest = [c for c in rows.columns if c not in keys and c != at]
    best = F.max(F.struct(F.col(at).isNotNull().alias("_has"), F.col(at), *rest)).alias("_best")
    return rows.groupBy(*keys).agg(best).select(*keys, f"_best.{at}", *[f"_best.`{c}`" for c in rest])


#: Unicode white space, as a regular expression class of Java.
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def plain(c: str) -> Column:
    """Trimmed, runs of white space as one space, lower case; null as empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), SPACE + "+", " ")))


def delivery_pairs(rows: DataFrame, snapshot: str, keys: list[str], values: list[str], at: str) -> DataFrame:
    """(snap, *keys, kh, vh): one row per snapshot and key, with hashes of the key and of the plain values."""
    clean = rows.dropna(subset=[snapshot, *keys])
    one = latest_rows(clean.select(snapshot, *keys, at, *[plain(v).alias(v) for v in values]), [snapshot, *keys], at)
    return one.select(
        F.col(snapshot).alias("snap"),
        *keys,
        F.xxhash64(*keys).alias("kh"),
        F.xxhash64(*[x for i, v in enumerate(values) for x in (F.lit(i), F.col(v))]).alias("vh"),
    )


def bucketed(pairs: DataFrame, buckets: int) -> DataFrame:
    """(snap, bucket, kh, vh, ck) of pairs; the same number of buckets has to be used for all deliveries that are compared."""
    return pairs.select("snap", F.pmod(F.xxhash64("kh", F.lit("bucket")), F.lit(buckets)).alias("bucket"), "kh", "vh", F.xxhash64("kh", "vh").alias("ck"))


def delivery_tables(hashed: DataFrame, cells: int) -> DataFrame:
    """The table of each snapshot and bucket: a row per cell, and one of cell -1 with the digest of all pairs.

    One shuffle of the pairs, by bucket, and not of the four times as many cell entries.
    """
    third = cells // 3
    at = [F.pmod(_part(i), F.lit(third)) + i * third for i in range(3)]
    spread = hashed.repartition("bucket").withColumn("cell", F.explode(F.array(*at, F.lit(-1).cast("long"))))
    return spread.groupBy("snap", "bucket", "cell").agg(F.count("*").alias("n"), F.bit_xor("kh").alias("kx"), F.bit_xor("vh").alias("vx"), F.bit_xor("ck").alias("cx"))


def differences(tables: DataFrame, order: list[tuple], cells: int, only: DataFrame | None = None) -> DataFrame:
    """(step, bucket, kind, kh, vh, sign) of the pairs that differ between the tables of each (new, old) of order.

    sign is 1 for a pair of the new side and -1 for one of the old. A bucket that can't be peeled is one row of kind
    "failed". only: (step, bucket), the ones to compare.
    """
    left = _subtracted(_sides(tables, order))
    if only is not None:
        left = left.join(only, ["step", "bucket"], "left_semi")
    return _peel(left, cells)


def snapshot_changes(rows: DataFrame, snapshot: str, keys: list[str], values: list[str], at: str, cells: int = CELLS, rounds: int = ROUNDS) -> DataFrame:
    """(snapshot, *keys, change_kind) of each snapshot against the nearest earlier one in rows.

    keys, as given, must be no longer than they are to be compared; values are compared by ``plain``.
    Of several rows of a key in a snapshot the one with the latest ``at`` counts. Rows with a null
    snapshot or key are left out. An empty table and one with a single snapshot have no change.
    """
    pairs = materialize(delivery_pairs(rows, snapshot, keys, values, at), "pairs")
    sizes = pairs.groupBy("snap").count().orderBy("snap").collect()  # one row per snapshot
    if len(sizes) < 2:
        return pairs.select(F.col("snap").alias(snapshot), *keys, F.lit("").alias("change_kind")).where("false")
    order = [(new["snap"], old["snap"]) for old, new in zip(sizes, sizes[1:])]
    hashed = bucketed(pairs, max(1, math.ceil(max(r["count"] for r in sizes) / KEYS_PER_BUCKET)))
    recovered, todo = None, None
    for _ in range(rounds + 1):
        part = hashed if todo is None else hashed.join(todo.select("bucket").distinct(), "bucket", "left_semi")
        tables = materialize(delivery_tables(part, cells), "tables")
        peeled = materialize(differences(tables, order, cells, todo), "peeled")
        drop_table_files(tables)
        good = peeled.where("kind = 'pair'").select("step", "kh", "vh", "sign")
        recovered = good if recovered is None else recovered.union(good)
        todo = peeled.where("kind = 'failed'").select("step", "bucket")
        if todo.isEmpty():
            break
        cells *= 4
    else:
        # Buckets of too many differences for any of these tables: pair by pair, those of one side are left.
        rest = _sides(hashed, order).join(todo, ["step", "bucket"], "left_semi")
        recovered = recovered.union(rest.groupBy("step", "kh", "vh").agg(F.sum("sign").cast("int").alias("sign")).where("sign <> 0"))
    # A recovered pair is of one row of its side, which parts keys of equal hash too.
    before = dict(order)
    old_of = F.create_map(*[_typed(pairs, x) for pair in before.items() for x in pair])
    named = recovered.withColumn("snap", F.when(F.col("sign") > 0, F.col("step")).otherwise(old_of[F.col("step")]))
    rows_of = pairs.join(named, ["snap", "kh", "vh"]).groupBy("step", *keys).agg(F.max("sign").alias("most"), F.min("sign").alias("least"))
    kind = F.when(F.col("most") < 0, "removed").when(F.col("least") > 0, "added").otherwise("changed")
    return rows_of.select(F.col("step").alias(snapshot), *keys, kind.alias("change_kind"))


def _typed(df: DataFrame, value: object) -> Column:
    return F.lit(value).cast(dict(df.dtypes)["snap"])


def _sides(df: DataFrame, order: list[tuple]) -> DataFrame:
    """Adds step and sign: each snapshot is the new side of one step and the old side of the next."""
    sides: dict = {}
    for new, old in order:
        sides.setdefault(new, []).append((new, 1))
        sides.setdefault(old, []).append((new, -1))
    steps = F.create_map(*[x for snap, part in sides.items() for x in (_typed(df, snap), F.array(*[F.struct(_typed(df, n).alias("step"), F.lit(sign).alias("sign")) for n, sign in part]))])
    return df.withColumn("_s", F.explode(steps[F.col("snap")])).select("*", "_s.step", "_s.sign").drop("_s")


def _subtracted(tables: DataFrame) -> DataFrame:
    """Cell by cell, the new side minus the old; cells that cancel out are left out."""
    out = tables.groupBy("step", "bucket", "cell").agg(
        F.sum(F.col("n") * F.col("sign")).alias("n"), F.bit_xor("kx").alias("kx"), F.bit_xor("vx").alias("vx"), F.bit_xor("cx").alias("cx")
    )
    return out.where("n <> 0 OR kx <> 0 OR vx <> 0 OR cx <> 0")


def _part(i: int) -> Column:
    """20 bits of a pair's hashes: where it stands in the i-th third of the cells."""
    return F.shiftright(F.col("kh").bitwiseXOR(F.col("vh")), 20 * i).bitwiseAND(F.lit(0xFFFFF))


def _check(kh: int, vh: int) -> int:
    """xxhash64(kh, vh) as Spark computes it: each value is hashed with the hash before as the seed."""
    first = xxhash.xxh64_intdigest(kh.to_bytes(8, "little", signed=True), 42)
    last = xxhash.xxh64_intdigest(vh.to_bytes(8, "little", signed=True), first)
    return last - (1 << 64) if last >> 63 else last


def _peel(tables: DataFrame, cells: int) -> DataFrame:
    """Pairs recovered from each table, or one row of kind 'failed'. A table has at most cells + 1 rows."""
    third, kind = cells // 3, dict(tables.dtypes)["step"]

    def peel(pdf: pd.DataFrame) -> pd.DataFrame:
        step, bucket = pdf["step"].iloc[0], int(pdf["bucket"].iloc[0])
        table = {int(c): [int(n), int(k), int(v), int(x)] for c, n, k, v, x in zip(pdf["cell"], pdf["n"], pdf["kx"], pdf["vx"], pdf["cx"])}
        digest, found, ready = table.pop(-1, [0, 0, 0, 0]), [], list(table)
        while ready:
            n, k, v, x = table[ready.pop()]
            if n not in (1, -1) or _check(k, v) != x:
                continue
            found.append((step, bucket, "pair", k, v, n))
            for row, at in [(digest, None)] + [(None, ((k ^ v) >> 20 * i & 0xFFFFF) % third + i * third) for i in range(3)]:
                row = table.setdefault(at, [0, 0, 0, 0]) if row is None else row
                row[:] = row[0] - n, row[1] ^ k, row[2] ^ v, row[3] ^ x
                if at is not None:
                    ready.append(at)
        if any(digest) or any(any(row) for row in table.values()):
            found = [(step, bucket, "failed", 0, 0, 0)]
        return pd.DataFrame(found, columns=["step", "bucket", "kind", "kh", "vh", "sign"])

    return tables.groupBy("step", "bucket").applyInPandas(peel, f"step {kind}, bucket long, kind string, kh long, vh long, sign int")


def bill_changes(snapshots: DataFrame) -> DataFrame:
    """(snapshot_no, session, bill_key, change_kind): bills added, removed or changed since the delivery before.

    bill_key is bill_id_display in upper case with only letters and digits kept; rows without one are left out.
    """
    key = F.regexp_replace(F.upper("bill_id_display"), r"[^\p{L}\p{Nd}]", "")
    rows = snapshots.select("snapshot_no", "session", F.when(key != "", key).alias("bill_key"), "status", "historyLine", "committee", "delivered_at")
    return snapshot_changes(rows, "snapshot_no", ["session", "bill_key"], ["status", "historyLine", "committee"], "delivered_at")
