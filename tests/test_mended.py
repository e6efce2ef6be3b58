"""Rules and operators that a review found wrong or absent; each case failed, or had no operator, before."""

import pytest
from pyspark.sql import functions as F

from lexspan import queries
from lexspan.functions import kernel as k
from lexspan.operators import documents, harness, search
from lexspan.plans.plain_meaning import FIELDS, RECORD, analyze, plain_meaning
from lexspan.sources import tables


def test_a_section_without_units_is_standard_and_has_no_prefix():
    got = analyze("NEW SECTION. Sec. 1. A note on parcels and nothing else.")
    assert (got["section_type"], got["detected_type"], got["plain_meaning"]) == ("standard", "addition", "No obligation or change detected in this section.")
    got = analyze("Sections 3 and 4 of the former act is repealed by intention; it seeks to help.")
    assert (got["section_type"], got["has_content"], got["units"]) == ("standard", False, [])


def test_list_markers_are_told_by_case():
    assert k.lead_in("The office shall: (a) keep a list.") and not k.lead_in("The office shall: (A) keep a list.")


def test_a_determination_that_another_law_defines_is_not_delegated():
    assert k.values("The fee is fair as determined by the board.")[0][1] == "delegated"
    assert k.values("The fee is fair as determined by the board as defined in RCW 1.") == []


def test_verbs_are_a_parameter(spark):
    text = "The board shall note that widgets frobnicate if a person may object."
    assert k.signals(text, frozenset({"frobnicate"})) != k.signals(text, frozenset()) or k.demonstrative(" widgets frobnicate now.", frozenset()) != k.demonstrative(" widgets frobnicate now.", frozenset({"frobnicate"}))
    df = spark.createDataFrame([("The seller is obligated to frobnicate lots.",)], "text string")
    action = lambda verbs: plain_meaning(df, fields=["units"], verbs=verbs).first()["result"]["units"][0]["action"]
    assert (action(frozenset()), action(frozenset({"frobnicate"}))) == ("be obligated to frobnicate lots", "frobnicate lots")


def test_a_session_is_met_by_its_biennium(spark):
    df = spark.createDataFrame([("2025-26",), ("2026",), ("2023-24",), (None,)], "session string")
    assert {r[0] for r in df.where(search.in_session("2026", 2026)).collect()} == {"2025-26", "2026"}


def test_signals_over_a_line_break(spark, tmp_path):
    rows = [(1, "1", "The board may\nnot sell the parcels.", None)]
    corpus = spark.createDataFrame(rows, "entry_id long, bill_number string, text string, sections array<struct<text string>>")
    corpus.write.parquet(f"{tmp_path}/bill_corpus.parquet")
    assert [r["signal"] for r in queries.signal(spark, str(tmp_path)).collect()] == [r["signal"] for r in queries.isc_units(spark, str(tmp_path)).collect()] == ["prohibition"]


def analyzed(spark, text, records, units="cast(array() AS array<struct<lens:string,anchor:string>>)"):
    lineage = spark.createDataFrame([(1, text, records)], f"k int, text string, lineage array<{RECORD}>")
    return lineage.select("k", "text", F.struct(F.expr(units).alias("units"), "lineage").alias("result"))


def record(i, parent, text, by, start, end, failed=False):
    return (i, parent, text, by, start, end, None, True, failed)


def test_wrong_positions_are_found(spark):
    good = [record(0, None, "One two. Three.", "root", 0, 15), record(1, 0, "One two.", "sentence_split", 0, 8), record(2, 0, "Three.", "sentence_split", 9, 15)]
    count = lambda rows: tuple(harness.positions(analyzed(spark, "One two. Three.", rows), "text", "k").first())[1:]
    assert count(good) == (3, 0, 0)
    assert count([good[0], record(1, 0, "One two.", "sentence_split", 1, 9)]) == (2, 0, 1)
    assert count([good[0], record(1, 0, "One two.", "sentence_split", None, None, True)]) == (2, 1, 1)
    assert count([good[0], record(1, 0, "One two.", "sentence_split", 1, 9, True)]) == (2, 1, 1)  # the flag is no excuse for a sentence
    assert count([good[0], record(1, 0, "One", "strike", 0, 8, True)]) == (2, 1, 0)


@pytest.mark.parametrize(
    "records,why",
    [
        ([record(0, None, "One two.", "root", 0, 8), record(1, 0, "One  ten.", "strike", 0, 8), record(2, 1, "One ten.", "sentence_split", 0, 8)], "strike"),
        ([record(0, None, "One two.", "root", 0, 8), record(1, 0, "One ten.", "sentence_split", 0, 8)], "sentence_split"),
        ([record(0, None, "One two.", "root", 0, 8), record(1, 0, "One ten.", "sentence_split", None, None, True)], "not covered"),
        ([record(0, None, "One two.", "root", 0, 8)], "not covered"),
    ],
)
def test_where_a_lost_anchor_left_its_source(spark, records, why):
    units = "array(named_struct('lens', 'x', 'anchor', 'One ten.'), named_struct('lens', 'fallback', 'anchor', 'gone'), named_struct('lens', 'x', 'anchor', 'One  two.'))"
    assert tuple(harness.anchored(analyzed(spark, "One two.", records, units), "text", "k").first())[1:] == (3, 1, why)


def test_paragraphs_find_their_anchors_and_their_repeats(spark):
    text = "NEW SECTION. Sec. 1. The agency shall keep files. The board shall keep files and may not sell files."
    rows = plain_meaning(spark.createDataFrame([(1, text), (2, text), (3, "A note."), (4, None)], "doc int, text string"), fields=["units", "plain_meaning"]).where("text IS NOT NULL")
    got = harness.paragraphs(rows, "doc")
    first = [(r["paragraph"], (r["anchor"] or "")[:10]) for r in got.where("doc = 1").orderBy("pos").collect()]
    assert first == [("New law — The agency must keep files.", "The agency"), ("The board must keep files.", "The board "), ("The board cannot sell files.", "The board ")]
    assert harness.repeated_paragraphs(got.withColumn("bill", F.lit(1)).withColumn("at", F.struct("doc", "pos")), "bill", "at", "paragraph", "anchor").isEmpty()
    other = got.withColumn("bill", F.lit(1)).withColumn("anchor", F.concat("doc", "anchor")).withColumn("at", F.struct("doc", "pos"))
    assert harness.repeated_paragraphs(other, "bill", "at", "paragraph", "anchor").count() == 3
    assert harness.repeated_paragraphs(other, "bill", "at", "paragraph", "anchor", ("The board must",)).count() == 2
    df = spark.createDataFrame([("To bE or not",), ("One. З law",), ("Failure to comply: x",), ("fine",), (None,)], "t string")
    assert [r[0] for r in df.select(harness.corruption(F.col("t"))).collect()] == ["bE", "stray preposition", "banned literal", None, None]


def test_detail_records(spark):
    xml = "<A><Legislation a='1'><LegalTitle> x &amp; y </LegalTitle><CurrentStatus><Status>In</Status><BillId>HB 1</BillId></CurrentStatus></Legislation></A>"
    got = {r["k"]: r for r in tables.legislation(spark.createDataFrame([(1, xml, "p"), (2, "<A/>", "q"), (3, None, None)], "k int, xml string, sponsor_note string"), "xml").collect()}
    assert (got[1]["legal_title"], got[1]["status"], got[1]["bill_id"], got[1]["veto"], got[1]["sponsor_note"]) == ("x & y", "In", "HB 1", None, "p")
    assert len(got) == 3 and all(got[i][c] is None for i in (2, 3) for c in (*tables.DETAIL.values(), *tables.STATUS.values()))


def test_document_urls(spark):
    page = '<a href="/x/1234.pdf">a</a><A class="y" HREF="/d/1234.htm?a=1&amp;b=2">b</A><a href="http://z/1234.html">c</a>'
    df = spark.createDataFrame([(page, "1234"), (page, "9"), ('<a href="http://z/1234.HTML">c</a>', "1234"), ("", "1"), (None, "1"), (page, None)], "h string, n string")
    assert [r[0] for r in df.select(documents.document_url(F.col("h"), F.col("n"), "https://h.gov/p")).collect()] == ["https://h.gov/d/1234.htm?a=1&b=2", None, "http://z/1234.HTML", None, None, None]


def test_bill_text(spark):
    body = "<p>Act ((old)) one</p><p>Sec. 1. The ((first)) board shall adopt rules.</p><p>--- END ---</p>"
    got = {r["k"]: r for r in documents.bill_text(spark.createDataFrame([(1, body), (2, ""), (3, None)], "k int, html string"), "k", "html").collect()}
    (section,) = got[1]["sections"]
    assert section["text"] == "Sec. 1. The board shall adopt rules." and [e["removed"] for e in section["preSourceLog"]] == ["</p>", "</p>", "((first))"]
    assert [e["type"] for e in got[1]["log"]] == ["structural_break", "struck_text"] and got[2]["sections"] == [] and not got[3]["sections"]


def test_known_issues_and_passes(spark):
    results = spark.createDataFrame([("1", "C1", False), ("1", "C4", True), ("2", "C1", None)], "bill_number string, check_code string, passed boolean")
    issues = spark.createDataFrame([("1", "C1", "why"), ("1", "C9", "never run"), ("7", "C1", "not tested"), ("1", "C4", "unused")], "bill_number string, check_code string, reason string")
    assert {tuple(r) for r in harness.resolved(results, issues).collect()} == {("1", "C1", True, "why"), ("1", "C4", True, None), ("1", "C9", True, "never run"), ("2", "C1", False, None)}
    pool = spark.range(10)
    assert tuple(harness.passes(pool, 8, 25).first()) == (3, 3) and tuple(harness.passes(pool.where("false"), 8, 25).first()) == (0, 0)


def test_results_without_a_number_are_kept(spark):
    schema = "bill_number string, session string, check_code string, tested_at int, received_at int, result_id long, passed boolean, reason string, xfail boolean"
    df = spark.createDataFrame([(None, "s", "C1", 1, 1, 1, True, None, None), (None, "s", "C1", 2, 1, 2, False, None, None), ("1", None, "C1", 1, 1, 3, True, None, None)], schema)
    one = harness.latest(df).select("bill_number", "session", "check_code", "result_id")
    assert {tuple(r) for r in one.collect()} == {(None, "s", "C1", 2), ("1", None, "C1", 3)}
    assert {tuple(r) for r in harness.upsert(one, one.withColumn("result_id", F.col("result_id") + 10), ["bill_number", "session", "check_code"]).collect()} == {(None, "s", "C1", 12), ("1", None, "C1", 13)}


def test_only_the_fields_asked_for_come_back(spark):
    df = spark.createDataFrame([("The board shall act on it.",)], "text string")
    assert plain_meaning(df, fields=["has_content"]).schema["result"].dataType.fieldNames() == ["has_content"]
    assert plain_meaning(df).schema["result"].dataType.fieldNames() == list(FIELDS)
