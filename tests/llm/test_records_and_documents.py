import datetime as dt
import random

import numpy as np
import numpy as np
import pytest

from lexspan.llm import languages, mixing
from lexspan.llm.packing import containers, nnls, pack, plan
from lexspan.llm.representatives import represent_bills, truth
from lexspan.llm.splitting import bill_items, pieces, split_bills, split_items
from lexspan.llm.tokens import encoder, n_tokens
from lexspan.runtime import table

INDEX = (
    "record_id long, bill_id_display string, bill_id_normalized string, bill_number string, chamber string, title string, legal_title string, session string, "
    "status string, sponsor string, introducedDate string, historyLine string, committee string, source_url string, detail_api_path string, feed string, "
    "fetched_at timestamp, loaded_at timestamp, entity string, trust_rank int, number string"
)


def bill(i, display, number, session, status, feed="bulk", day=1, **more):
    base = dict.fromkeys(["chamber", "title", "legal_title", "sponsor", "introducedDate", "historyLine", "committee", "source_url", "detail_api_path"]) | more
    t = dt.datetime(2025, 1, day) if day else None
    return (i, display, None, number, base["chamber"], base["title"], base["legal_title"], session, status, base["sponsor"], base["introducedDate"], base["historyLine"],
            base["committee"], base["source_url"], base["detail_api_path"], feed, t, t, "clash", 9, "clash")


def represent(spark, rows):
    words = spark.createDataFrame([("n/a",), ("-",)], "placeholder string")
    trust = spark.createDataFrame([("detail", 1), ("bulk", 2)], "feed string, trust_rank int")
    return {r["first_id"]: r for r in represent_bills(spark.createDataFrame(rows, INDEX), words, trust).collect()}


def test_representatives(spark):
    rows = [
        bill(3, "HB 1001", "1001", "2025-26", "N/A ", title="t", day=5),
        bill(1, "Substitute", "0001001", "2025/26", "passed", day=2),
        bill(2, "2SHB 1001", None, " 2025-2026", None, "detail", 9, title="t"),
        bill(4, "HB 1001", "1001.0", "2023-24", None), bill(5, "H.B. 1001", "-", "2023-24", " ", "detail"),
        bill(6, None, None, "2023-24", "x"), bill(7, "HB 7", "7", None, "x"), bill(8, "HB 9", "#9", "2023-24", "x", day=None), bill(9, "HB 9", "9", "2023-24", "x", day=None),
    ]
    got = represent(spark, rows)
    assert set(got) == {1, 4, 8}
    assert (got[1]["n_records"], got[1]["survivor_id"], got[1]["status_id"], got[1]["bill_number"]) == (3, 3, 1, "1001")
    assert (got[4]["survivor_id"], got[4]["status_id"], got[4]["status"]) == (4, -1, None)
    assert (got[8]["survivor_id"], got[8]["status_id"]) == (8, 8)
    assert represent(spark, []) == {}


def test_truth_discovery_trusts_the_source_that_is_right_elsewhere(spark):
    day = dt.datetime(2025, 1, 1)
    rows = [(f"e{i}", "f", "right", s, 1, day) for i in range(20) for s in ("good", "ok")] + [(f"e{i}", "f", "wrong", "bad", 1, day) for i in range(20)]
    rows += [("z", "f", "a", "good", 1, day), ("z", "f", "b", "bad", 1, day), ("alone", "f", "v", "bad", 1, None)]
    rows += [("own", "f", "one vote", "bad", 1, day), ("own", "f", "three votes", "bad", 3, None), ("tie", "f", "x", "ok", 1, None), ("tie", "f", "y", "ok", 1, day)]
    found = truth(spark.createDataFrame([(*r[:5], 0, r[5], 0) for r in rows], "entity string, field string, value string, source string, n long, rank long, at timestamp, place long"))
    got = {r["entity"]: r["value"] for r in found.best.collect()}
    assert got["z"] == "a" and got["alone"] == "v" and got["own"] == "three votes" and got["tie"] == "y"
    assert found.weights["good", "f"] > found.weights["bad", "f"] and found.moved < 1e-6


@pytest.mark.parametrize("size,overlap", [(50, 10), (200, 0), (33, 32)])
def test_pieces_round_trip(size, overlap):
    rng = random.Random(size)
    for _ in range(200):
        t = "".join(rng.choice(["Sec. 3. ", "\n\n", "\n(a) ", "word ", "x" * 70, ". A", "。", "é", "\n"]) for _ in range(rng.randint(0, 60)))
        out = pieces(t, size, overlap)
        assert all(b - a <= size for a, b, _ in out) and out[0][0] == 0 and out[-1][1] == len(t)
        assert all(n[0] == p[1] - overlap for p, n in zip(out, out[1:]))
        assert t[: out[0][1]] + "".join(t[a + overlap : b] for a, b, _ in out[1:]) == t


def test_pieces_prefer_the_coarser_boundary():
    t = "a b. " * 8 + "\n\n" + "c d. " * 11
    assert pieces(t, 60, 5)[0][1] == 42


def test_split_bills(spark):
    part = "id string, sectionNumber string, isNewSection boolean, text string, preSourceLog array<struct<type:string,removed:string,location:string>>"
    rows = [(1, "t", [("a", None, False, "x" * 2001, []), ("b", None, False, None, []), ("c", None, False, "", [])]), (2, "y " * 3000, None), (3, None, None), (4, "z", []), (5, None, [None])]
    df = spark.createDataFrame(rows, f"entry_id long, text string, sections array<struct<{part.replace(' ', ':', 1).replace(', sectionNumber ', ',sectionNumber:').replace(', isNewSection ', ',isNewSection:').replace(', text ', ',text:').replace(', preSourceLog ', ',preSourceLog:')}>>")
    got = {(r["entry_id"], r["section_pos"]): len(r["pieces"]) for r in split_bills(df).collect()}
    assert got == {(1, 0): 2, (1, 2): 1, (2, 0): 4}
    assert bill_items(df).count() == 6
    with pytest.raises(ValueError):
        split_items(df, "text", 10, 10)


def test_plan_uses_every_size_once_and_fills_well():
    rng = np.random.default_rng(1)
    counts = {int(s): int(n) for s, n in zip(*np.unique(rng.integers(1, 512, 5000), return_counts=True))} | {512: 40}
    got = plan(counts, 512)
    used = {}
    for combo, n in got:
        assert sum(combo) <= 512 and n > 0
        for s in combo:
            used[s] = used.get(s, 0) + n
    assert used == counts
    assert sum(s * n for s, n in counts.items()) / (512 * sum(n for _, n in got)) > 0.985
    assert plan({}, 512) == []


def test_nnls_finds_an_exact_mixture():
    x = nnls([(3, 1), (2, 2), (4,)], np.array([0, 5, 8, 5, 2]))
    assert np.allclose(x, [5, 4, 2], atol=0.05)


def test_pack(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([1, 7, 50, 50, 50, 99, 100, 101, 250, 300, 0]), 0, "q") for i in range(400)] + [(400, None, 0, "q"), (401, 100_000, 0, "q")]
    df = spark.createDataFrame(rows, "doc long, n int, part_size int, item string")
    placed = pack(df, "doc", "n", 100)
    out = placed.collect()
    per = {}
    for r in out:
        per.setdefault(r["item"], []).append((r["part_no"], r["part_start"], r["part_size"]))
    for i, n, *_ in rows:
        parts = sorted(per.get(i, []))
        assert sum(p[2] for p in parts) == (n or 0)
        assert [p[0] for p in parts] == list(range(len(parts))) and all(p[1] == k * 100 for k, p in enumerate(parts))
        assert len(parts) == -(-(n or 0) // 100)
    bins = containers(placed, 100).collect()
    assert all(0 < b["fill"] <= 100 for b in bins) and sorted(b["container_id"] for b in bins) == list(range(len(bins)))
    assert pack(df.where("false"), "doc", "n", 100).isEmpty()


def test_tokens_of_whole_texts(spark):
    text = "Каждый tenant shall pay. " * 50
    df = spark.createDataFrame([(text,), (None,), ("",)], "text string")
    assert [r[0] for r in df.select(n_tokens("text")).collect()] == [len(encoder(__import__("lexspan.llm.tokens", fromlist=["x"]).DEFAULT_VOCABULARY).encode_ordinary(text)), 0, 0]


def mix_docs(spark, n=3000):
    rng = random.Random(6)
    rows = [(i, f"text {i} " + "w" * rng.randint(1, 200), rng.choice(["big source", "Big-Source", "small", None, "other"] if i % 9 else ["tiny"]), 3) for i in range(n)]
    rows += [(n + 1, rows[0][1], "big source", 3), (n + 2, None, "tiny", 3), (n + 3, "", "tiny", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, u int")


def test_mixture_reaches_its_shares(spark):
    from pyspark.sql import functions as F

    targets = spark.createDataFrame([("big_source", 0.6, 1), ("small", 0.2, 2), ("tiny", 0.2, 4), ("absent", 0.0, 2)], "source string, target_share double, max_repeats int")
    chosen, shares = mixing.choose(mix_docs(spark), "doc_id", "text", "source", F.length("text"), targets)
    rows = chosen.collect()
    caps = {"big_source": 1, "small": 2, "tiny": 4}
    assert rows and all(1 <= r["n_used"] <= caps[r["source"]] for r in rows)
    assert len({r["doc"] for r in rows}) == len(rows) and not {0, 3001} <= {r["doc"] for r in rows}
    got = {r["source"]: r["reached_share"] for r in shares.collect()}
    assert all(abs(got[s] - w) < 0.01 for s, w in (("big_source", 0.6), ("small", 0.2), ("tiny", 0.2))) and got["absent"] == 0
    assert {r["source"]: r["target_met"] for r in shares.collect()}["absent"]
    order = [(r["doc"], r["copy_no"]) for r in mixing.mixture(chosen).collect()]
    assert len(order) == sum(r["n_used"] for r in rows) and order != sorted(order)


def test_mixture_of_nothing(spark):
    from pyspark.sql import functions as F

    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    chosen, shares = mixing.choose(mix_docs(spark).where("false"), "doc_id", "text", "source", F.length("text"), targets)
    assert chosen.isEmpty() and [r["reached_share"] for r in shares.collect()] == [0.0]


def test_poisson_counts_have_their_mean():
    even = (np.arange(1, 10001) / 10000, np.ones(10000, int))
    for mean, cap in ((0.8, 1), (2.5, 4), (0.05, 3)):
        rate = mixing._calibrated(even, mean * 10000, cap)
        assert abs(sum(1 - s for s in mixing.poisson_steps(rate, cap)) - mean) < 0.001
    assert mixing._calibrated(even, 0, 2) < 0.001


@pytest.fixture(scope="module")
def classifier(spark, sf):
    folder = sf.replace("sf0.001", "sf0.01")
    return languages.train(*(table(spark, folder, t) for t in ("lang_samples", "documents", "lang_aliases")))


def test_held_out_units_get_their_language(spark, sf, classifier):
    """Whole documents of another table whose label is a plain code of a language; some labels are wrong."""
    docs = table(spark, sf, "documents").where("length(lang) = 2 AND length(text) > 60").collect()
    right = 0
    known = [d for d in docs if d["lang"] in classifier.langs]
    for d in known:
        size = {}
        for a, b, g, _ in classifier.segments(d["text"]):
            size[g] = size.get(g, 0) + b - a
        right += max(size, key=size.get, default=None) == d["lang"]
    assert right / len(known) > 0.9


def test_mixed_text_quotations_and_figures(classifier):
    en = "The committee should send a notice before the hearing unless the date is moved. Every tenant must keep records for five years."
    es = "La comisión deberá enviar un aviso antes de la audiencia. Cada inquilino tendrá que guardar los registros durante cinco años."
    got = classifier.segments(en + "\n---\n" + es + "\n2024 | 12,3 | 44\n" + en.upper())
    assert [g for _, _, g, _ in got] == ["en", "es", "en"] and all(0 < c <= 1 for *_, c in got)
    assert got[1][1] - got[1][0] >= 110
    assert [g for _, _, g, _ in classifier.segments(en + ' ("Ley de cruces") ' + en) if g != "en"] == []
    assert classifier.segments("2024 | 12 | 13\n2025 | 14 | 15") == [] and classifier.segments("") == []


def test_wrong_labels(spark, classifier):
    en, es = "Every tenant must keep records for five years and send a notice before the hearing. ", "Cada inquilino tendrá que guardar los registros durante cinco años y enviar un aviso. "
    rows = [(1, " EN ", en), (2, "es", en), (3, None, en), (4, "english", en + es), (5, "xx", "1 | 2"), (6, "xx", None), (7, "??", ""), (8, "en", "Hi.")]
    docs = spark.createDataFrame([(*r, 1.0, "f") for r in rows], "doc_id long, lang string, text string, confidence double, found string")
    aliases = spark.createDataFrame([("en", "en"), ("english", "en"), ("es", "es")], "label_form string, lang string")
    labelled = languages.label(docs.select("doc_id", "lang", "text"), "text", classifier)
    got = {tuple(r) for r in languages.wrong_labels(labelled, aliases, 60).collect()}
    assert got == {(2, "en"), (3, "en"), (4, "en"), (4, "es")}
    per = {r["doc_id"]: r["found_lang"] for r in languages.document_labels(labelled).collect()}
    assert per[1] == "en" and per[6] is None and len(per) == 8
    assert languages.wrong_labels(labelled.where("false"), aliases.where("false"), 60).isEmpty()


def test_no_samples_no_languages(spark):
    none = spark.createDataFrame([], "lang string, text string, doc_id long, label_form string")
    empty = languages.train(none, none, none)
    assert empty.segments("Some text that nothing is known about.") == []
