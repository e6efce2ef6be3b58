
import pytest
from pyspark.sql import functions as F

from lexspan import queries
from lexspan.operators import documents, search


def write(spark, folder, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_every_fiftieth_record_is_searched(spark, tmp_path):
    fields = "record_id long, " + ", ".join(f"{c} string" for c in [*search.FIELDS, "legal_title"])
    rows = [(i, f"HB {1000 + i}", None, str(1000 + i), "House", f"Word{i % 7} safety", "2025-26", None, None) for i in range(1, 120)]
    index = spark.createDataFrame(rows, fields)
    corpus = spark.createDataFrame([(1, "1050", [("a word1 here",)])], "entry_id long, bill_number string, sections array<struct<text string>>")
    got = queries.search_topk(spark, write(spark, tmp_path, bill_index=index, bill_corpus=corpus)).collect()
    assert {r["query"] for r in got} == {"HB 1552", "ferry crossing safety plan", "Word1 safety", "Word2 safety"}
    best = [r for r in got if r["query"] == "Word1 safety"]
    assert len(best) == 10 and (best[0]["record_id"], best[0]["score"]) == (50, 185) and best[1]["score"] == 180


@pytest.mark.parametrize("few", [search.FEW_PARTS, 0])
def test_many_searches_equal_one_by_one(spark, few):
    rows = [(1, "HB 1000", None, "1000", "House", "Lantern safety", "2025-26", None, ["46"]), (2, "HB 1001", None, "1001", "House", "HB 1000 repeal", "2025-26", None, ["12"]), (3, None, None, None, None, None, None, None, ["46"])]
    index = spark.createDataFrame(rows, "record_id int, " + ", ".join(f"{c} string" for c in search.FIELDS) + ", rcw_titles array<string>")
    bodies = spark.createDataFrame([("1001", "a lantern of\nmotor vehicles")], "bill_number string, body string")
    asked, phrases = ["HB 1000", "lantern", "a a lan", "  ", "-", "vehicle motor", "motor"], {"motor": "safety"}
    titles = spark.createDataFrame([("vehicle", "46")], "word string, rcw_title string")
    many = search.search_many(index, bodies, spark.createDataFrame(list(enumerate(asked)), "query_id long, query string"), phrases, titles=titles, few=few)
    got = sorted((r["query"], r["record_id"], r["score"]) for r in many.collect())
    one = lambda q: search.search(index, bodies, q, phrases, titles={"46"} if "vehicle" in q else None)
    assert got == sorted((q, r["record_id"], r["score"]) for q in asked for r in one(q).collect())
    assert ("vehicle motor", 3, 1) in got


@pytest.mark.parametrize("few", [search.FEW_PARTS, 0])
def test_parts_are_found_in_longer_strings(spark, few):
    parts, wholes = ["a", "ab", "abab", "é", "lantern safety", "zz", ""], ["", "abab", "xé", "a lantern safety b", "nothing"]
    df = lambda name, xs: spark.createDataFrame([(x,) for x in xs], f"{name} string")
    got = {tuple(r) for r in search.contained(df("part", parts), df("whole", wholes), few).collect()}
    assert got == {(p, w) for p in parts for w in wholes if p and p in w}
    assert search.contained(df("part", []), df("whole", wholes), few).isEmpty()


def test_history_of_every_record_that_has_any(spark, tmp_path):
    rows = [(1, "Rep. A", "Jan 3 Returned to Ferries & Harbors."), (2, None, "Feb 4 <b> & Passed."), (3, "Sen. B & C", None), (4, None, None), (5, " ", "Mar 5 Read.")]
    folder = write(spark, tmp_path, bill_index=spark.createDataFrame(rows, "record_id long, sponsor string, historyLine string"))
    got = {r["record_id"]: (r["sponsor"], r["introduced"], r["last_action"]) for r in queries.html_history(spark, folder).collect()}
    assert got == {
        1: ("Rep. A", "Jan 3", "Jan 3 — Returned to Ferries & Harbors."), 2: (None, "Feb 4", "Feb 4 — <b> & Passed."),
        3: ("Sen. B & C", None, None), 5: (None, "Mar 5", "Mar 5 — Read."),
    }


def test_decimal_numbers_are_in_the_coverage_pool(spark, tmp_path):
    numbers = ["5154.0", "5154", " 1017 ", "0002923", "9001.0", "12.5", "n/a", "", None, "NaN", "12d", "HB 7", "99999999999"]
    index = spark.createDataFrame([(n,) for n in numbers], "bill_number string")
    folder = write(spark, tmp_path, bill_index=index, sentinel_bills=spark.createDataFrame([("9001",)], "bill_number string"))
    assert sorted(r["n"] for r in queries.cov_pool(spark, folder).collect()) == [1017, 2923, 5154]
    assert {r["n"] for r in queries.cov_sample(spark, folder).collect()} == {1017, 2923, 5154}


def test_texts_without_sections_are_read(spark, tmp_path):
    schema = "entry_id long, bill_number string, text string, sections array<struct<text string>>"
    two = "Title\nSec. 1. The board shall adopt fair rules.\nSec. 2. The agency may act on the rules."
    rows = [(1, "1", "unused", [("The owner must notify the board.",)]), (2, "2", two, None), (3, "3", "The buyer shall keep records.", []), (4, "4", " \n", None), (5, "5", None, None), (6, "6", "x", [(None,)])]
    folder = write(spark, tmp_path, bill_corpus=spark.createDataFrame(rows, schema))
    assert sorted((r["entry_id"], r["section_pos"], (r["text"] or "")[:12]) for r in queries.sections(spark, folder).collect()) == [
        (1, 0, "The owner mu"), (2, 0, "Sec. 1. The "), (2, 1, "Sec. 2. The "), (3, 0, "The buyer sh"), (6, 0, ""),
    ]
    keys = lambda df: sorted((r["entry_id"], r["section_pos"], r["signal"]) for r in df.collect())
    assert keys(queries.stream_units(spark, folder)) == keys(queries.isc_units(spark, folder)) == [(1, 0, "obligation"), (2, 0, "obligation"), (2, 1, "permission"), (3, 0, "obligation")]


def test_deletions_are_logged_as_of_their_section(spark):
    body = "<p>Act ((old)) one<br/></p><div>Sec. 1. The ((first)) board shall adopt rules.</div><p>NEW SECTION. Sec. 2. The agency may act ((on\nit)) now.</p><p>Sec. 3. x</p>"
    pages = spark.createDataFrame([(1, body), (2, "<p>No ((struck)) heading at all</p>"), (3, ""), (4, None)], "k int, html string")
    got = sorted((r["k"], -1 if r["section_pos"] is None else r["section_pos"], r["section_number"], r["log_no"], r["type"], r["removed"]) for r in documents.presource_log(pages, "k", "html").collect())
    s, t = "structural_break", "struck_text"
    assert got == [
        (1, -1, None, 0, s, "<br/>"), (1, -1, None, 1, s, "</p>"), (1, -1, None, 2, t, "((old))"), (1, 0, "1", 0, s, "</div>"), (1, 0, "1", 1, t, "((first))"),
        (1, 1, "2", 0, s, "</p>"), (1, 1, "2", 1, t, "((on\nit))"), (2, 0, None, 0, s, "</p>"), (2, 0, None, 1, t, "((struck))"),
    ]


def test_the_log_is_built_from_every_page(spark, sf):
    got = queries.presource_build(spark, sf).groupBy("type").agg(F.countDistinct("entry_id").alias("n")).collect()
    n = queries.pages(spark, sf).count()
    assert {r["type"]: r["n"] for r in got}["structural_break"] == n and {r["type"] for r in got} == {"structural_break", "struck_text"}
