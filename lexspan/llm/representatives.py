"""Best representative of each duplicate group, by iterative truth discovery.

Records are grouped into entities by a key. Every filled value of a field is a claim of the
record's source, with a number of votes. Truth discovery alternates two steps until the source
weights no longer move: each (entity, field) takes the value with the greatest sum of votes times its
sources' weights, and each source's weight in a field becomes the negative logarithm of its rate of
claims that lost. The entity comes out with the highest-supported value of each field and its share
of the votes. The surviving record and the record of the status are fields like the others: every
record claims itself as the survivor, with as many votes as it has filled fields, and every record
with a status claims itself as the status record, with one vote; ties go to the more trusted, then the
later, then the smaller claim.

Claims are pre-aggregated to (entity, field, value, source) with their votes before anything else. Only
fields of entities on which several sources disagree take part in the rounds: one source's weight is a
common factor of all values that only it claims. Each round is three aggregations with a map-side
combine, so an entity that holds a third of all rows is no hot group. Weights by source and field are
all that the driver holds and what is broadcast; ``MAX_WEIGHTS`` bounds them.

Null keys form no entity. A field that no record fills comes out null with support null. Extra
columns are ignored.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.runtime import materialize, small

#: Weights (sources times fields) that there may be.
MAX_WEIGHTS = 10_000
#: The string fields of an index record whose filled values are counted.
FIELDS = (
    "bill_id_display bill_id_normalized bill_number chamber title legal_title session status sponsor introducedDate historyLine committee source_url detail_api_path"
).split()
#: White space as trimmed from both ends of a value.
BLANK = r"[\s\xa0 -  　]+"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}|{BLANK}$", "")


class Truth(NamedTuple):
    """best: (entity, field, value, support). weights: of each (source, field). moved: how far they went in the last round."""

    best: DataFrame
    weights: dict[tuple[str, str], float]
    moved: float


def truth(claims: DataFrame, tolerance: float = 1e-6, max_rounds: int = 30) -> Truth:
    """The highest-supported value of each entity and field.

    claims: (entity, field, value, source, n, rank, at, place), one row per distinct combination of the first four; n
    are its votes. Ties go to the smaller rank, the later at, the smaller place, the smaller value.
    """
    base = _winners(claims, {}, F.when(F.col("low") == F.col("high"), "agreed").when(F.col("one") == F.col("other"), "alone").otherwise("open").alias("state"))
    base = materialize(base.withColumn("support", F.when(F.col("state") == "agreed", 1.0).otherwise(F.col("support"))), "base")
    tagged = materialize(claims.join(base.select("entity", "field", F.col("value").alias("won"), "state"), ["entity", "field"]), "tagged")
    settled, disputed = base.where("state <> 'open'").drop("state"), tagged.where("state = 'open'").drop("won", "state")
    # What doesn't change from round to round: the claims of agreed and lone fields that were right.
    fixed = _rates(tagged.where("state <> 'open'"))
    rated = set(fixed) | {(r[0], r[1]) for r in small(disputed.select("source", "field").distinct(), MAX_WEIGHTS)}
    weights = {k: 1.0 for k in rated}
    best, moved = _winners(disputed, weights), 0.0
    for _ in range(max_rounds if not disputed.isEmpty() else 0):
        raw = {}
        now = _rates(disputed.join(best.select("entity", "field", F.col("value").alias("won")), ["entity", "field"]))
        for k in rated:
            n, ok = (a + b for a, b in zip(fixed.get(k, (0.0, 0.0)), now.get(k, (0.0, 0.0))))
            # Half a lost vote is added, so that a source that never lost keeps a finite weight.
            raw[k] = -math.log((n - ok + 0.5) / (n + 1.0))
        top = {f: max(v for (_, g), v in raw.items() if g == f) for f in {k[1] for k in rated}}
        new = {k: v / top[k[1]] if top[k[1]] > 0 else 1.0 for k, v in raw.items()}
        moved, weights = max(abs(new[k] - weights[k]) for k in rated), new
        best = _winners(disputed, weights)
        if moved < tolerance:
            break
    return Truth(settled.unionByName(best), weights, moved)


def _rates(claims: DataFrame) -> dict[tuple[str, str], tuple[float, float]]:
    """(votes, votes for the winner, the column won) of each source and field."""
    sums = claims.groupBy("source", "field").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("value") == F.col("won"), F.col("n")).otherwise(0)).alias("ok"))
    return {(r["source"], r["field"]): (float(r["n"]), float(r["ok"])) for r in small(sums, MAX_WEIGHTS)}


def _winners(claims: DataFrame, weights: dict[tuple[str, str], float], *more: Column) -> DataFrame:
    """The value with the greatest sum of weighted votes of each entity and field; with no weights each is 1.

    more: further columns of the least and greatest value (low, high) and source (one, other).
    """
    weight = F.lit(1.0)
    if weights:
        table = claims.sparkSession.createDataFrame([(s, f, w) for (s, f), w in sorted(weights.items())], "source string, field string, weight double")
        claims, weight = claims.join(F.broadcast(table), ["source", "field"]), F.col("weight")  # at most MAX_WEIGHTS rows
    late = -F.coalesce(F.unix_micros(F.col("at").cast("timestamp")), F.lit(-(1 << 62)))
    votes = claims.groupBy("entity", "field", "value").agg(F.round(F.sum(F.col("n") * weight), 9).alias("score"), F.min(F.struct(F.col("rank"), late.alias("late"), F.col("place"))).alias("tie"), F.min("source").alias("one"), F.max("source").alias("other"))
    first = F.struct(-F.col("score"), F.col("tie"), F.col("value"), F.col("score"))
    span = (F.min("value").alias("low"), F.max("value").alias("high"), F.min("one").alias("one"), F.max("other").alias("other")) if more else ()
    top = votes.groupBy("entity", "field").agg(F.min(first).alias("w"), F.sum("score").alias("all"), *span)
    return top.select("entity", "field", "w.value", F.when(F.col("all") > 0, F.col("w.score") / F.col("all")).otherwise(F.lit(0.0)).alias("support"), *more)


def bill_records(index: DataFrame, placeholders: DataFrame, trust: DataFrame) -> DataFrame:
    """bill_index with its bill (biennium and number), filled values and trust, one row per record."""
    empty = [r[0] for r in small(placeholders, 1000) if r[0] is not None]
    texts = list(FIELDS)
    index = index.select("record_id", "feed", "fetched_at", *texts)  # other columns may have any name

    def filled(c: str) -> Column:
        v = stripped(F.col(c))
        return F.when((v != "") & ~F.lower(v).isin(empty), v)

    number = F.regexp_extract(F.regexp_replace(filled("bill_number"), r"\.0+$", ""), r"0*(\d+)\D*$", 1)
    named = F.upper(filled("bill_id_display"))
    named = F.regexp_replace(F.regexp_replace(F.regexp_replace(named, r"HOUSE BILL", "HB"), r"SENATE BILL", "SB"), r"\bNO\b", "")
    squeezed = F.regexp_replace(named, r"[^A-Z0-9]", "")
    own = F.regexp_extract(squeezed, r"0*(\d+)$", 1)
    year = F.regexp_extract("session", r"(\d{4})", 1).try_cast("int")
    ranked = trust.groupBy(F.col("feed").alias("feed_known")).agg(F.min("trust_rank").alias("trust_rank"))
    return (
        index.join(ranked, F.col("feed") == F.col("feed_known"), "left")
        .select(
            "record_id",
            (year - F.pmod(year + 1, F.lit(2))).alias("biennium"),
            F.coalesce(F.nullif(number, F.lit("")), F.nullif(own, F.lit(""))).alias("number"),
            F.nullif(number, F.lit("")).alias("v_bill_number"),
            F.when(own != "", F.concat(F.regexp_replace(squeezed, r"\d+$", ""), F.lit(" "), own)).alias("v_bill_id_display"),
            filled("status").alias("v_status"),
            sum((filled(c).isNotNull().cast("int") for c in texts), F.lit(0)).alias("n_filled"),
            F.coalesce("trust_rank", F.lit(1 << 30)).alias("trust_rank"),
            F.coalesce("feed", F.lit("")).alias("source"),
            "fetched_at",
        )
        .where("biennium IS NOT NULL AND number IS NOT NULL")
        .withColumn("entity", F.concat_ws("/", "biennium", "number"))
    )


#: The fields whose values are chosen.
VALUES = ("bill_number", "bill_id_display", "status")


def bill_claims(records: DataFrame) -> DataFrame:
    """The claims of bill records: the values of VALUES by their feeds, and each record as the survivor and the status record."""
    none = F.lit(0).cast("long")
    claim = lambda field, value, source, n, rank, place: F.struct(
        F.lit(field).alias("field"), value.alias("value"), source.alias("source"), n.cast("long").alias("n"), rank.cast("long").alias("rank"), place.cast("long").alias("place")
    )
    me, own = F.col("record_id").cast("string"), F.lit("")
    each = [claim(f, F.col(f"v_{f}"), F.col("source"), F.lit(1), none, none) for f in VALUES]
    each.append(claim("survivor", me, own, F.col("n_filled"), F.col("trust_rank"), F.col("record_id")))
    each.append(claim("status_record", F.when(F.col("v_status").isNotNull(), me), own, F.lit(1), none, F.col("record_id")))
    rows = records.select("entity", "fetched_at", F.explode(F.array(*each)).alias("c")).where("c.value IS NOT NULL")
    return rows.groupBy("entity", "c.field", "c.value", "c.source").agg(F.sum("c.n").alias("n"), F.min("c.rank").alias("rank"), F.max("fetched_at").alias("at"), F.min("c.place").alias("place"))


def represent_bills(index: DataFrame, placeholders: DataFrame, trust: DataFrame) -> DataFrame:
    """One row per bill: its number of records and smallest record_id, survivor, status record, and the chosen values with their support.

    All but the first two are what truth discovery chose; status_id is -1 where no record has a status.
    """
    return _represented(materialize(bill_records(index, placeholders, trust), "records"))[0]


def _represented(records: DataFrame) -> tuple[DataFrame, Truth, DataFrame]:
    """The representatives, the truth they come from, and the claims."""
    claims = materialize(bill_claims(records), "claims")
    found = truth(claims)
    bills = records.groupBy("entity", "biennium", "number").agg(F.count("*").alias("n_records"), F.min("record_id").alias("first_id"))
    named = lambda f, c: F.max(F.when(F.col("field") == f, F.col(c)))
    wide = found.best.groupBy("entity").agg(
        named("survivor", "value").cast("long").alias("survivor_id"),
        F.coalesce(named("status_record", "value").cast("long"), F.lit(-1)).cast("long").alias("status_id"),
        *[x for f in VALUES for x in (named(f, "value").alias(f), named(f, "support").alias(f"{f}_support"))],
    )
    return bills.join(wide, "entity").drop("entity"), found, claims


def checked(index: DataFrame, placeholders: DataFrame, trust: DataFrame) -> DataFrame:
    """One row of what must hold of the representatives: (n_bills, n_records, n_unclaimed, n_unsupported, n_moving).

    n_unclaimed: chosen values that no record of the bill claims. n_unsupported: values whose support isn't above 0 and
    at most 1. n_moving: 1 if the weights were still moving at the end.
    """
    out, found, claims = _represented(materialize(bill_records(index, placeholders, trust), "records"))
    chosen = found.best.where(F.col("field").isin(*VALUES))
    unclaimed = chosen.join(claims.select("entity", "field", "value").distinct(), ["entity", "field", "value"], "left_anti")
    one = lambda df, *cols: df.agg(*cols).withColumn("k", F.lit(1))
    parts = [
        one(out, F.count("*").alias("n_bills"), F.sum("n_records").alias("n_records")),
        one(unclaimed, F.count("*").alias("n_unclaimed")),
        one(chosen, F.count_if(~(F.col("support") > 0) | (F.col("support") > 1 + 1e-9)).alias("n_unsupported")),
    ]
    return parts[0].join(parts[1], "k").join(parts[2], "k").drop("k").withColumn("n_moving", F.lit(int(found.moved >= 1e-6)).cast("long"))
