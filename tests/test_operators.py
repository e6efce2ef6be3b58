import json

import pytest
from pyspark.sql import functions as F

from lexspan.operators import documents, harness, search, selection
from lexspan.sources import sinks, tables


def test_biennium_and_number(spark):
    df = spark.createDataFrame([("2023-24",), ("2024",), ("2023",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(search.biennium(F.col("s"), 2026)).collect()] == ["2023-24", "2023-24", "2023-24", "2025-26", "2025-26"]
    df = spark.createDataFrame([("HB 1234",), ("RCW 70A.565.020 and 5057",), ("12345",), (None,)], "s string")
    assert [r[0] for r in df.select(search.bill_number(F.col("s"))).collect()] == ["1234", "5057", "", ""]


def test_search_scores_and_order(spark):
    rows = [(1, "HB 1000", None, "1000", "House", "Lantern safety", "2025-26", None), (2, "HB 1001", None, "1001", "House", "HB 1000 repeal", "2025-26", None), (3, None, None, None, None, None, None, None)]
    index = spark.createDataFrame(rows, "record_id int, " + ", ".join(f"{c} string" for c in search.FIELDS))
    bodies = spark.createDataFrame([("1001", "a lantern")], "bill_number string, body string")
    got = {r["record_id"]: r["score"] for r in search.search(index, bodies, "HB 1000").collect()}
    assert got == {1: 100 + 40 + 20 + 20, 2: 40 + 20 + 20}
    assert [(r["record_id"], r["score"]) for r in search.search(index, bodies, "lantern").collect()] == [(1, 70), (2, 5)]
    assert search.search(index, bodies, "  ").isEmpty() and search.search(index, bodies, "lantern", session="1999").isEmpty()
    assert search.expand("motor vehicle fee", {"vehicle": "a", "motor vehicle": "b"}) == ["motor vehicle fee", "b", "a"]
    titled = index.withColumn("rcw_titles", F.array(F.lit("46")))
    assert {r["score"] for r in search.search(titled, bodies, "zzz", titles={"46"}).collect()} == {1}


def test_official_first(spark):
    a = spark.createDataFrame([("HB 1", "2025-26", 0)], "bill_id_display string, session string, score int")
    b = spark.createDataFrame([("hb1", "2025-26", 9), ("HB 2", None, 5)], "bill_id_display string, session string, score int")
    assert [r["bill_id_display"] for r in search.official_first(a, b).collect()] == ["HB 1", "HB 2"]


def test_rules_are_runs_of_sentences(spark):
    text = "This is a note about the department. The board shall adopt the rules here. This is so except as RCW 1.2 says. The agency may act when it is asked."
    found = selection.units(spark.createDataFrame([(1, 0, text), (2, 0, None), (3, 0, "")], "doc int, sec int, text string"), "doc", "sec")
    got = sorted((r["doc"], r["rule_no"], r["rule_type"], r["n_units"], len(r["conditions"]), len(r["exceptions"]), len(r["references"])) for r in selection.rules(found, "doc", "sec").collect())
    assert got == [(1, 1, "obligation", 2, 0, 1, 1), (1, 2, "permission", 1, 1, 0, 0)]


def test_harness(spark):
    old = spark.createDataFrame([("1", "C1", True), ("2", "C1", None)], "b string, c string, ok boolean")
    new = spark.createDataFrame([("2", "C1", False), ("3", "C1", True)], "b string, c string, ok boolean")
    assert {tuple(r) for r in harness.upsert(old, new, ["b", "c"]).collect()} == {("1", "C1", True), ("2", "C1", False), ("3", "C1", True)}
    pool = spark.createDataFrame([(n,) for n in (5, 999, 1000, 2500, 7000)], "n int")
    picks = lambda c, k: [r["n"] for r in harness.coverage_sample(pool, c, k).orderBy("pick_no").collect()]
    assert picks(0, 2) == [5, 999] and picks(4, 3) == [7000, 5, 999] and picks(7, 1) == [1000]
    rows = [(1, 1, "a", "x"), (1, 2, "a", "x"), (1, 3, "a", "y"), (1, 4, "b", "z"), (2, 1, "a", None), (2, 2, "a", None)]
    df = spark.createDataFrame(rows, "bill int, pos int, t string, anchor string")
    assert {(r["bill"], r["pos"]) for r in harness.repeated_paragraphs(df, "bill", "pos", "t", "anchor").collect()} == {(1, 3), (2, 2)}
    df = spark.createDataFrame([("fetch failed: x",), ("boom",), (None,)], "e string")
    assert [r[0] for r in df.select(harness.failure_kind(F.col("e"))).collect()] == ["unreachable", "error", None]


def test_documents(spark):
    urls = spark.createDataFrame([("https://a/b",), ("//c/d",), ("/e",), ("f.pdf",), ("mailto:x",)], "u string")
    assert [r[0] for r in urls.select(documents.absolute(F.col("u"), "https://h.gov/x/y")).collect()] == ["https://a/b", "https://c/d", "https://h.gov/e", "https://h.gov/x/f.pdf", None]
    page = "<p>Sponsors: Rep. A Companion: none</p><li>Jan 3 First reading.</li><li>Feb 10 Passed.</li>"
    got = spark.createDataFrame([(page,), ("none",), (None,)], "h string").select(documents.history(F.col("h")).alias("x")).collect()
    assert got[0]["x"]["introduced"] == "Jan 3" and got[0]["x"]["last_action"] == "Feb 10 — Passed." and got[1]["x"]["introduced"] is None
    struck = spark.createDataFrame([(1, "x ((a)) Sec. 1. y ((b)) Sec. 2. ((c))")], "k int, t string")
    assert [(r["removed"], r["section_number"]) for r in documents.struck_sections(struck, "k", "t").orderBy("pos").collect()] == [("a", None), ("b", "1"), ("c", "2")]
    x, h = spark.createDataFrame([(1, "a", "")], "k int, p string, q string"), spark.createDataFrame([(1, "z", "b"), (2, "c", None)], "k int, p string, q string")
    assert {tuple(r) for r in documents.detail(x, h, "k", ["p", "q"]).collect()} == {(1, "a", "b", "xml"), (2, "c", None, "html")}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps([{"bill_number": "1", "title": "t"}, {"bill_number": None}]))
    assert tables.read_index(spark, str(tmp_path / "i.json")).count() == 2
    assert tables.read_corpus(spark, str(tmp_path / "none.json")).isEmpty()
    (tmp_path / "bad.json").write_text("{not json")
    assert tables.read_corpus(spark, str(tmp_path / "bad.json")).isEmpty()
    df = spark.range(3).withColumn("v", F.lit("a"))
    path = str(tmp_path / "out")
    assert sinks.publish(df, path) and sinks.current(spark, path).count() == 3
    assert not sinks.publish(df.where("false"), path) and sinks.current(spark, path).count() == 3
    assert sinks.publish(df.limit(1), path) and sinks.current(spark, path).count() == 1
    assert sinks.publish_upserted(df.withColumn("v", F.lit("b")).limit(2), path, ["id"]) and {tuple(r) for r in sinks.current(spark, path).collect()} == {(0, "b"), (1, "b")}
    assert len(list((tmp_path / "out").glob("version-*"))) == 2
    with pytest.raises(FileNotFoundError):
        sinks.current(spark, str(tmp_path / "nothing"))
    (tmp_path / "mixed.json").write_text('[{"bill_number": "1", "text": "a"}, {"bill_number": "2", "sections": "no list"}]')
    assert {(r["bill_number"], r["error"]) for r in tables.read_corpus(spark, str(tmp_path / "mixed.json")).collect()} == {("1", None), ("2", "damaged entry")}
    (tmp_path / "words.json").write_text('["Run", " run ", "", "adopt"]')
    assert {r["word"] for r in tables.read_words(spark, str(tmp_path / "words.json")).collect()} == {"run", "adopt"}
    (tmp_path / "map.json").write_text('{"titles": {"Tax": ["Title 82", "Title 84"]}, "phrases": {"motor vehicle": "vehicle"}}')
    assert {tuple(r) for r in tables.read_synonyms(spark, str(tmp_path / "map.json"), "titles").collect()} == {("tax", "Title 82"), ("tax", "Title 84")}
    assert [tuple(r) for r in tables.read_synonyms(spark, str(tmp_path / "map.json"), "phrases").collect()] == [("motor vehicle", "vehicle")]
    last = tables.keep_last(spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, None)], "k string, o int, v string"), "k", "o")
    assert {tuple(r) for r in last.collect()} == {("a", 3, "y", 1), ("b", 2, None, 2)}


def test_stream_gives_the_units_of_the_batch(spark, tmp_path):
    from lexspan.plans.plain_meaning import plain_meaning, units
    from lexspan.streaming.sections import stream_units, write

    df = spark.createDataFrame([(1, "The board shall adopt rules."), (2, "The agency may act on it."), (3, None)], "doc long, text string")
    df.write.parquet(str(tmp_path / "in"))
    query = write(stream_units(spark, str(tmp_path / "in"), df.schema, "doc"), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("doc", "signal", "sentence").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, units(plain_meaning(df), "doc").select("doc", "signal", "sentence").collect()))
