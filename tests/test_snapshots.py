import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lexspan.core import snapshots
from lexspan.core.snapshots import bill_changes, latest_rows, snapshot_changes

SCHEMA = (
    "snapshot_no int, snapshot_date date, bill_id_display string, bill_number string, session string, sponsor string, "
    "status string, historyLine string, committee string, delivered_at timestamp, step int, sign int, kh long"
)


def at(h):
    return dt.datetime(2025, 1, 1) + dt.timedelta(hours=h)


def row(snap, bill, status, hours=0, session="2025-26", history=None, committee=None):
    return (snap, None, bill, None, session, None, status, history, committee, at(hours) if hours is not None else None, 5, 6, 7)


def found(df):
    return {tuple(r) for r in df.collect()}


def test_kinds_spelling_repeats_and_missing_numbers(spark):
    rows = [
        row(1, "HB 1", "In  Rules "), row(1, "SB 2", "a"), row(1, "HB 3", None), row(1, "HB 4", "x", history="h"), row(1, "HB 6", "same"),
        row(3, "hb-1", "in rules"), row(3, "HB 3", ""), row(3, "HB 4", "x", history="other"), row(3, "HB 5", "new"), row(3, "HB 6", "same"), row(3, "HB 6", "same"),
        row(4, "HB 1", "later", 5), row(4, "HB 1", "in rules", 9), row(4, "HB 3", None), row(4, "HB 4", "x", history="other"), row(4, "HB 5", "y"), row(4, "HB 6", "same"),
        row(3, None, "no id"), row(3, "--", "no letters"), row(None, "HB 9", "no number"), row(4, "HB 1", "older", None),
    ]
    got = found(bill_changes(spark.createDataFrame(rows, SCHEMA)))
    assert got == {
        (3, "2025-26", "SB2", "removed"), (3, "2025-26", "HB4", "changed"), (3, "2025-26", "HB5", "added"), (4, "2025-26", "HB5", "changed"),
    }


def test_empty_and_single(spark):
    assert bill_changes(spark.createDataFrame([], SCHEMA)).isEmpty()
    assert bill_changes(spark.createDataFrame([row(2, "HB 1", "a")], SCHEMA)).isEmpty()


@pytest.mark.parametrize("change,rounds", [(0.02, 3), (0.6, 3), (0.6, 0)])
def test_against_brute_force_with_failing_buckets(spark, change, rounds):
    rng = random.Random(4)
    state, rows, want = {f"HB {i}": "s" for i in range(900)}, [], set()
    for snap in (1, 2, 5):
        new = dict(state)
        if snap > 1:
            for k in list(state):
                if rng.random() < change:
                    new[k] = f"s{snap}"
                elif rng.random() < change / 4:
                    del new[k]
            new.update({f"SB {snap}{i}": "n" for i in range(20)})
            for k in state.keys() | new.keys():
                if state.get(k) != new.get(k):
                    kind = "added" if k not in state else "removed" if k not in new else "changed"
                    want.add((snap, "2025-26", k.replace(" ", ""), kind))
        state = new
        rows += [row(snap, k, v) for k, v in state.items()]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("bill_key", F.replace("bill_id_display", F.lit(" "), F.lit("")))
    assert found(snapshot_changes(df, "snapshot_no", ["session", "bill_key"], ["status", "historyLine", "committee"], "delivered_at", 24, rounds)) == want


def test_a_stored_table_is_compared_without_its_rows(spark, tmp_path):
    day = lambda snap, values: snapshots.bucketed(snapshots.delivery_pairs(spark.createDataFrame([(snap, k, v, 1) for k, v in values.items()], "snap int, k string, v string, t int"), "snap", ["k"], ["v"], "t"), 1)
    first = {f"k{i}": "a" for i in range(200)}
    snapshots.delivery_tables(day(1, first), 96).write.parquet(str(tmp_path / "first"))
    second = snapshots.delivery_tables(day(2, {**first, "k3": "b", "new": "c"}), 96)
    got = snapshots.differences(spark.read.parquet(str(tmp_path / "first")).union(second), [(2, 1)], 96).collect()
    assert sorted(r["sign"] for r in got) == [-1, 1, 1] and {r["kind"] for r in got} == {"pair"}


def test_other_key_types(spark):
    df = spark.createDataFrame([("a", 1, "x", 1), ("b", 1, "y", 1), ("b", 2, "z", 1)], "snap string, id int, v string, t int")
    assert found(snapshot_changes(df, "snap", ["id"], ["v"], "t")) == {("b", 1, "changed"), ("b", 2, "added")}


def test_latest_rows_breaks_ties_by_values(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, None, "c"), (2, None, "d")], "k int, t int, v string")
    assert {tuple(r) for r in latest_rows(df, ["k"], "t").collect()} == {(1, 5, "b"), (2, None, "d")}
