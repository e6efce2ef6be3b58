"""Checks of rendered bills, their statistics, and the systematic coverage sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.functions.rules import has
from lexspan.functions.text import squeeze, strike, trim

#: Literals that no rendered text may hold (fixed values).
BANNED = ["Failure to comply:"]


def well_formed(c: Column) -> Column:
    """Not empty, and without a banned literal."""
    ok = F.length(squeeze(F.coalesce(c, F.lit("")))) > 0
    for b in BANNED:
        ok = ok & ~F.coalesce(c, F.lit("")).contains(b)
    return ok


def dollar_artefact(c: Column) -> Column:
    return has(F.coalesce(c, F.lit("")), r"\$\d+,\s\d{3}")


def anchored(analyzed: DataFrame, source: str, *keys: str) -> DataFrame:
    """(keys, n_units, n_lost, divergence) of each section with units: those whose anchor isn't a part of it, white space aside.

    divergence says for the first lost one where its lineage leaves the source. In the row of the section, without a join.
    """
    units = F.col("result.units")
    # The source is squeezed once a section, as the only element of an array, and not once a unit.
    lost = F.element_at(F.transform(F.array(squeeze(F.col(source))), lambda t: F.filter(units, lambda u: (u["lens"] != "fallback") & ~F.contains(t, squeeze(u["anchor"])))), 1)
    rows = analyzed.where(F.size(units) > 0).select(*keys, F.size(units).cast("long").alias("n_units"), F.size(lost).cast("long").alias("n_lost"), F.try_element_at(lost, F.lit(1))["anchor"].alias("_a"), F.col(source).alias("_t"), F.col("result.lineage").alias("_r"))
    return rows.select(*keys, "n_units", "n_lost", F.when(F.col("n_lost") > 0, divergence(F.col("_r"), F.col("_a"), F.col("_t"))).alias("divergence"))


def divergence(records: Column, anchor: Column, source: Column) -> Column:
    """The step of the first record, from the root to the anchor's sentence, whose span of the source isn't its text, white space aside.

    "not covered" where no record reports the anchor, or the lineage is sound to its end. Records without a place and
    those flagged as not located are passed over.
    """
    leaf = F.element_at(F.filter(records, lambda r: (r["produced_by"] == "sentence_split") & (r["text"] == anchor)), 1)
    # The records that led to the sentence: those of the preamble, which come in the order of the chain, and its own.
    chain = F.filter(records, lambda r: ~r["produced_by"].isin("sentence_split", "constraint_filter", "inclusion_list_detect", "marker_skipped") | (r["id"] == leaf["id"]))
    off = F.filter(chain, lambda r: r["start"].isNotNull() & ~r["locate_failed"] & (squeeze(F.substring(source, r["start"] + 1, r["end"] - r["start"])) != squeeze(r["text"])))
    there = F.exists(records, lambda r: (r["produced_by"] == "sentence_split") & (r["text"] == anchor))
    return F.when(~there, "not covered").otherwise(F.coalesce(F.try_element_at(off, F.lit(1))["produced_by"], F.lit("not covered")))


def positions(analyzed: DataFrame, source: str, *keys: str) -> DataFrame:
    """(keys, n_records, n_flagged, n_wrong): lineage records whose span of the section isn't their text and that don't say so.

    A sentence without a place counts as wrong, and so does one whose span, without struck text, has other words than
    it. n_flagged are those that say that they differ, as steps do that took something out of the middle. In the row of
    the section, without a join.
    """
    records = F.col("result.lineage")
    part = lambda r: F.substring(F.col(source), r["start"] + 1, r["end"] - r["start"])
    sentence = lambda r: (r["produced_by"] == "sentence_split") & (r["start"].isNull() | (squeeze(strike(part(r))) != squeeze(r["text"])))
    wrong = F.filter(records, lambda r: F.coalesce(~r["locate_failed"] & r["start"].isNotNull() & (part(r) != r["text"]), F.lit(False)) | sentence(r))
    return analyzed.select(*keys, F.size(records).cast("long").alias("n_records"), F.size(F.filter(records, lambda r: r["locate_failed"])).cast("long").alias("n_flagged"), F.size(wrong).cast("long").alias("n_wrong"))


#: Paragraphs that many sections have by right, and the beginning of one more (fixed values).
STATIC = ["No obligation or change detected in this section.", "This section is repealed and no longer in effect."]
PREFIX = r"(?:New law|Amends existing law|Funding|Effective [^—\n]+) — "
#: Signs of a damaged text: letters of another script or case where a word starts (fixed values).
CORRUPTION = [("bE", r"bE"), ("stray preposition", r"(?:\A|\n|[.!?]\s)[ЗС] (?=[A-Za-z])"), ("banned literal", "Failure to comply:")]


def corruption(c: Column) -> Column:
    """The first sign of a damaged text; null if there is none."""
    out = None
    for name, pattern in CORRUPTION:
        test = F.regexp_like(c, F.lit(pattern))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def paragraphs(analyzed: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, paragraph, anchor): the paragraphs of each section's plain meaning with the anchor they come from.

    A paragraph is of the first unit whose sentence it is, as it stands, after a prefix, or as one of its halves; an
    anchor of null where there is none.
    """
    result = F.col("result")
    parts = F.filter(F.transform(F.split(result["plain_meaning"], "\n\n", -1), trim), lambda p: F.length(p) > 0)
    rows = analyzed.select(*keys, F.filter(result["units"], lambda u: u["sentence"].isNotNull()).alias("_u"), F.posexplode(parts).alias("pos", "paragraph"))
    p = F.col("paragraph")
    mine = lambda u: (
        (u["sentence"] == p)
        | (p.endswith(u["sentence"]) & F.regexp_like(F.substring(p, F.lit(1), F.length(p) - F.length(u["sentence"])), F.lit(rf"\A{PREFIX}\z")))
        | F.array_contains(F.transform(F.split(u["sentence"], "\n\n", -1), trim), p)
    )
    return rows.select(*keys, "pos", "paragraph", F.try_element_at(F.filter("_u", mine), F.lit(1))["anchor"].alias("anchor"))


def repeated_paragraphs(paragraphs: DataFrame, bill: str, pos: str, text: str, anchor: str, boilerplate: tuple[str, ...] = ()) -> DataFrame:
    """Paragraphs that repeat an earlier one of the bill with another anchor, or with none; static ones apart.

    boilerplate: beginnings of further paragraphs that may recur.
    """
    rest = [f for f in paragraphs.columns if f not in (bill, pos, text, anchor)]
    static = F.col(text).isin(STATIC) | F.regexp_like(text, F.lit(rf"\A{PREFIX}No obligation or change detected in this section\.\z"))
    for b in boilerplate:
        static = static | F.col(text).startswith(b)
    # Most paragraphs stand once, so the first is found by an aggregate with a map-side combine, and no window gathers a group.
    kept = paragraphs.where(~static)
    first = kept.groupBy(bill, text).agg(F.min(F.struct(F.col(pos).alias("at"), F.col(anchor).alias("first_anchor"))).alias("_f"), F.count("*").alias("_n")).where("_n > 1")
    both = kept.join(first, [bill, text])
    same = F.coalesce(F.col("_f.first_anchor") == F.col(anchor), F.lit(False))
    return both.where((F.col(pos) != F.col("_f.at")) & ~same).select(bill, pos, text, anchor, *rest)


def latest(results: DataFrame) -> DataFrame:
    """One result per bill, session and check: the last tested, then received, then the greatest id.

    Results without a bill number are those of one bill, the one without a number.
    """
    row = F.struct("tested_at", "received_at", "result_id", "passed", "reason", "xfail")
    best = results.groupBy("bill_number", "session", "check_code").agg(F.max(row).alias("r"))
    return best.select("bill_number", "session", "check_code", "r.result_id", "r.passed", "r.reason", "r.xfail", "r.tested_at")


def expected_failures(results: DataFrame) -> DataFrame:
    """A known failure passes, with a note."""
    known = F.coalesce("xfail", F.lit(False)) & ~F.coalesce("passed", F.lit(False))
    return results.withColumn("effective", F.coalesce("passed", F.lit(False)) | known).withColumn(
        "note", F.when(known, F.concat(F.lit("expected failure: "), F.coalesce("reason", F.lit("no reason"))))
    )


def resolved(results: DataFrame, issues: DataFrame) -> DataFrame:
    """(bill_number, check_code, passed, note): results against a table of known issues (bill_number, check_code, reason).

    A failure with a known issue passes, with its reason as the note. A known issue of a tested bill whose check has no
    result is noted as a pass. issues has one row per bill and check; of several the smallest reason counts.
    """
    known = issues.groupBy("bill_number", "check_code").agg(F.min("reason").alias("issue"))
    mine = known.join(results.select("bill_number").distinct(), "bill_number", "left_semi")
    both = results.select("bill_number", "check_code", F.coalesce("passed", F.lit(False)).alias("ok"), F.lit(True).alias("run")).join(mine, ["bill_number", "check_code"], "full")
    failed = ~F.coalesce("ok", F.lit(False))
    return both.select("bill_number", "check_code", (F.coalesce("ok", F.lit(False)) | F.col("issue").isNotNull()).alias("passed"), F.when(failed, F.col("issue")).alias("note"))


def statistics(results: DataFrame) -> DataFrame:
    """(check_code, n_pass, n_fail), expected failures as passes."""
    return expected_failures(results).groupBy("check_code").agg(F.count_if("effective").alias("n_pass"), F.count_if(~F.col("effective")).alias("n_fail"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; where both have a key, the new row. A null key meets a null one."""
    values = [c for c in old.columns if c not in keys]
    a, b = (df.select(F.struct(*keys).alias("k"), F.struct(*values).alias("v")).alias(name) for df, name in ((old, "a"), (new, "b")))
    same = [F.col(f"a.k.{k}").eqNullSafe(F.col(f"b.k.{k}")) for k in keys]
    return a.join(b, same, "full").select(F.coalesce("a.k", "b.k").alias("k"), F.coalesce("b.v", "a.v").alias("v")).select("k.*", "v.*")


def whole_number(c: Column) -> Column:
    """The number as an int; null for anything but a number without a fraction."""
    n = F.when(c.rlike(r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"), c.try_cast("double"))
    return F.when(n == F.floor(n), n.try_cast("int"))


def coverage_pool(index: DataFrame, excluded: DataFrame) -> DataFrame:
    """Distinct whole bill numbers that aren't excluded; "5154.0" is 5154."""
    pool = index.select(whole_number(F.col("bill_number")).alias("n")).where("n IS NOT NULL").distinct()
    return pool.join(excluded.select(whole_number(F.col("bill_number")).alias("n")), "n", "left_anti")


def coverage_sample(pool: DataFrame, cursor: int, size: int) -> DataFrame:
    """The next ``size`` numbers of the sorted pool from the cursor on, wrapping around.

    A number's place is its count of smaller ones: those of its range of 1,000 by a window, those of
    lower ranges by their sums, so the whole pool is in no single task.
    """
    block = F.floor(F.col("n") / 1000)
    w = Window.partitionBy("block").orderBy("n")
    placed = pool.withColumn("block", block).withColumn("i", F.row_number().over(w) - 1)
    sums = pool.groupBy(block.alias("block")).agg(F.count("*").alias("k"))
    before = sums.withColumn("base", F.coalesce(F.sum("k").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = sums.agg(F.sum("k").alias("total")).first()["total"] or 1
    off = F.pmod(F.col("i") + F.col("base") - F.lit(cursor), F.lit(total))
    return placed.join(before.select("block", "base"), "block").where(off < size).select("n", off.alias("pick_no"))


def passes(pool: DataFrame, cursor: int, size: int) -> DataFrame:
    """(cursor, passes): where the next sample starts, and how often this one went through the whole pool; an empty pool gives 0 and 0."""
    n = F.count("*")
    return pool.agg(F.when(n > 0, F.pmod(F.lit(cursor + size), n)).otherwise(0).alias("cursor"), F.when(n > 0, F.floor(F.lit(cursor + size) / n)).otherwise(0).alias("passes"))


def failure_kind(c: Column) -> Column:
    """Whether a message says that a source was unreachable."""
    return F.when(has(c, r"document search failed|bill document fetch failed|fetch failed|ECONNREFUSED|ENOTFOUND|ETIMEDOUT|AbortError|timed? ?out"), "unreachable").when(c.isNotNull(), "error")
