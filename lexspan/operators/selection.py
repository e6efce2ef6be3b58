"""Multi-label classes of sentences, references, and rules grouped from runs of sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.functions.rules import every, has
from lexspan.functions.text import sentences, squeeze

#: Classes and their words, in the order in which they are listed (fixed values).
CLASSES = [
    ("prohibition", r"\b(?:may not|must not|shall not|prohibited from|is prohibited)\b"),
    ("obligation", r"\b(?:must|shall|required to|is required to|are required to)\b"),
    ("permission", r"\bmay\b"),
    ("condition", r"\b(?:if|unless|when|only if|provided that|subject to)\b"),
    ("exception", r"\b(?:except|exception|does not apply|notwithstanding)\b"),
    ("definition", r"\b(?:means|is defined as|are defined as|definition)\b"),
    ("reference", r"\b(?:RCW|executive order|federal law|court order|agency|department|Nlets|ACCESS|DAPS)\b"),
]
PRIORITY = ["prohibition", "obligation", "permission", "definition", "condition", "exception", "reference"]
REFERENCES = [
    ("rcw", r"\bRCW\s+[0-9A-Za-z.]+(?:\s+[0-9A-Za-z.()]+)?"),
    ("executive_order", r"\b(?:governor'?s\s+)?executive order\b[^.;]*"),
    ("federal_law", r"\bfederal law\b[^.;]*"),
    ("court_order", r"\bcourt order\b[^.;]*"),
    ("system", r"\b(?:Nlets|ACCESS|DAPS)\b"),
]


def classes(c: Column) -> Column:
    """All classes of a sentence, in order; permission only where nothing says "may not"."""
    tests = [F.when(has(c, p) & ~has(c, r"\bmay not\b") if name == "permission" else has(c, p), name) for name, p in CLASSES]
    return F.array_compact(F.array(*tests))


def primary(types: Column) -> Column:
    return F.coalesce(*[F.when(F.array_contains(types, p), p) for p in PRIORITY], F.lit("context"))


def references(c: Column) -> Column:
    """array<struct<type, text>>, kind by kind."""

    def typed(name: str, pattern: str) -> Column:
        return F.transform(every(c, pattern), lambda t: F.struct(F.lit(name).alias("type"), t.alias("text")))

    return F.flatten(F.array(*[typed(*r) for r in REFERENCES]))


def units(sections: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, pos, primary_type, signal_types, source_span, references): labelled sentences; pos counts all of them."""
    rows = sections.select(*keys, F.posexplode(sentences(squeeze(F.col(text)), 20, "A-Z(")).alias("pos", "source_span"))
    return (
        rows.withColumn("signal_types", classes(F.col("source_span")))
        .where(F.size("signal_types") > 0)
        .select(*keys, "pos", primary(F.col("signal_types")).alias("primary_type"), "signal_types", "source_span", references(F.col("source_span")).alias("references"))
    )


def rules(units: DataFrame, document: str, *order: str) -> DataFrame:
    """One row per rule: an obligation, prohibition or permission and the sentences that follow it up to the next.

    Sentences before the first rule of a document belong to none. Conditions, exceptions and references
    accumulate in order. The window is partitioned by document, whose size bounds it.
    """
    place = F.struct(*order, "pos")
    starts = F.col("primary_type").isin("obligation", "prohibition", "permission")
    w = Window.partitionBy(document).orderBy(*order, "pos")
    numbered = units.withColumn("rule_no", F.sum(F.when(starts, 1).otherwise(0)).over(w)).where("rule_no > 0")
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(place.alias("at"), c.alias("v")))), lambda x: x["v"])
    spans = lambda kind: ordered(F.when(F.array_contains("signal_types", kind), F.col("source_span")))
    return numbered.groupBy(document, "rule_no").agg(
        F.min_by("primary_type", place).alias("rule_type"),
        F.min_by("source_span", place).alias("source_span"),
        F.count("*").alias("n_units"),
        F.array_compact(spans("condition")).alias("conditions"),
        F.array_compact(spans("exception")).alias("exceptions"),
        F.flatten(ordered(F.col("references"))).alias("references"),
    )


def summary(units: DataFrame) -> DataFrame:
    return units.groupBy("primary_type").agg(F.count("*").alias("n_units"))
