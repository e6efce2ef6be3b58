import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from lexspan.llm.near_duplicates import NearDuplicates, components
from lexspan.llm.shared_spans import SpanIndex, shared_report, shared_spans

CORPUS = "entry_id long, text string, rec string, fp int, a string, cls int, lo string"
EXTRA = ("x", 1, "y", 2, "z")


def corpus(spark, rows):
    """Rows of (id, text) with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in rows], CORPUS)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def texts(seed=3, n=24):
    """Texts that borrow stretches of each other, with copies, a null, an empty and a very long one."""
    rng = random.Random(seed)
    rows = [words(rng, rng.randint(5, 60)) for _ in range(n)]
    for _ in range(n):
        a, b = rng.randrange(n), rng.randrange(n)
        at, size, to = rng.randrange(len(rows[a])), rng.randint(10, 120), rng.randrange(len(rows[b]))
        rows[b] = rows[b][:to] + rows[a][at : at + size] + rows[b][to:]
    rows += [rows[0], rows[0], None, "", "short", "ab" * 90, words(rng, 3000) + rows[1], "né ü" * 30 + rows[2][:70] + "𝔘𝔫𝔦"]
    return list(enumerate(rows))


def brute_spans(rows, n):
    where = {}
    for i, t in rows:
        for p in range(len(t or "") - n + 1):
            where.setdefault(t[p : p + n], set()).add(i)
    out = set()
    for i, t in rows:
        start = end = None
        for p in range(len(t or "") - n + 1):
            if len(where[t[p : p + n]]) > 1:
                if end is not None and p <= end:
                    end = p + n
                else:
                    if end is not None:
                        out.add((i, start, end))
                    start, end = p, p + n
        if end is not None:
            out.add((i, start, end))
    return out


@pytest.mark.parametrize("batches,window", [(1, None), (3, 12), (2, 30)])
def test_spans_are_those_of_brute_force(spark, batches, window):
    rows = texts()
    got = {tuple(r) for r in shared_spans(corpus(spark, rows), "entry_id", "text", 30, batches, window).collect()}
    assert got == brute_spans(rows, 30) and got


def test_compaction_changes_nothing(spark):
    rows = texts(5)
    df = corpus(spark, rows)
    index = SpanIndex(spark, 30, max_runs=1)
    for b in range(3):
        index.ingest(df.where(f"entry_id % 3 = {b}"), "entry_id", "text")
    assert len(index.state["runs"]) == 1
    assert {tuple(r) for r in index.spans(df, "entry_id", "text").collect()} == brute_spans(rows, 30)


@pytest.mark.parametrize("limits", [{"slice_chars": 90}, {"contexts": 1}])
def test_slices_and_keys_change_nothing(spark, limits):
    rows = texts(7)
    assert {tuple(r) for r in shared_spans(corpus(spark, rows), "entry_id", "text", 30, 1, **limits).collect()} == brute_spans(rows, 30)


def test_repeated_rows_are_one_record(spark):
    rows = texts(9)
    df = corpus(spark, rows + rows[:12])
    assert {tuple(r) for r in shared_spans(df, "entry_id", "text", 30, 2).collect()} == brute_spans(rows, 30)


def test_an_index_is_opened_again(spark, tmp_path):
    rows = texts(8)
    df = corpus(spark, rows)
    path = f"file://{tmp_path}/index"
    for b in range(3):
        SpanIndex(spark, 30, max_runs=2, path=path).ingest(df.where(f"entry_id % 3 = {b}"), "entry_id", "text")
    again = SpanIndex(spark, path=path)
    assert again.min_len == 30 and len(again.state["runs"]) == 1 and len(again.state["places"]) == 3
    assert {tuple(r) for r in again.spans(df, "entry_id", "text").collect()} == brute_spans(rows, 30)
    again.drop()
    assert not (tmp_path / "index").exists()


def test_a_window_of_a_third_of_all_records_is_one_row_of_a_run(spark):
    rng, common = random.Random(4), words(random.Random(5), 12)
    rows = [(i, (common if i % 3 == 0 else "") + words(rng, 25)) for i in range(300)]
    index = SpanIndex(spark, 30)
    index.ingest(corpus(spark, rows), "entry_id", "text")
    (run,) = index.state["runs"]
    heads = spark.read.parquet(run["path"])
    places = spark.read.parquet(*index.state["places"])
    assert places.groupBy("fp").count().agg({"count": "max"}).first()[0] >= 100 and heads.count() == heads.select("fp").distinct().count()
    assert {tuple(r) for r in index.spans(corpus(spark, rows), "entry_id", "text").collect()} == brute_spans(rows, 30)


def test_ingest_reports_what_a_batch_shares_with_history(spark):
    t = words(random.Random(1), 40)
    index = SpanIndex(spark, 30)
    assert index.ingest(corpus(spark, [(1, t)]), "entry_id", "text").isEmpty()
    assert not index.ingest(corpus(spark, [(2, "new " + t)]), "entry_id", "text").isEmpty()


def test_report_and_empty_table(spark):
    rows = [(1, "a" * 40 + "b"), (2, "c" + "a" * 40), (3, None), (4, "")]
    df = corpus(spark, rows)
    report = {r["rec"]: (r["n_chars"], r["shared_chars"]) for r in shared_report(df, shared_spans(df, "entry_id", "text", 30), "entry_id", "text").collect()}
    assert report == {1: (41, 40), 2: (41, 40), 3: (0, 0), 4: (0, 0)}
    assert shared_spans(corpus(spark, []), "entry_id", "text", 30).isEmpty()


def near_texts(seed=2):
    rng = random.Random(seed)
    rows = []
    for _ in range(12):
        base = words(rng, 80).split()
        rows.append(" ".join(base))
        for edits in (1, 3, 6, 12):
            other = list(base)
            for _ in range(edits):
                other[rng.randrange(len(other))] = "zz" + str(rng.randrange(99))
            rows.append(" ".join(other).upper())
    return list(enumerate(rows + [rows[0], rows[0] + "!", None, "", "one two", "Ünï cödé " * 3]))


def brute_pairs(rows, n, least):
    sets = {}
    for i, t in rows:
        w = re.findall("[a-z0-9]+", (t or "").lower())
        if len(w) >= n:
            sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


@pytest.mark.parametrize("n,least", [(3, 0.7), (5, 0.8)])
def test_pairs_are_those_of_brute_force(spark, n, least):
    rows = near_texts()
    nd = NearDuplicates(corpus(spark, rows), "entry_id", "text", least, n)
    want = brute_pairs(rows, n, least)
    assert {tuple(r) for r in nd.pairs().collect()} == want and want
    groups = {r["rec"]: r for r in nd.groups().collect()}
    assert set(groups) == {i for i, _ in rows}
    for a, b in want:
        assert groups[a]["group_id"] == groups[b]["group_id"]
    copies = [groups[i]["class_id"] for i, t in rows if (t or "").rstrip("!") == rows[0][1]]
    assert len(copies) == 3 and len(set(copies)) == 1
    last = rows[-2][0]
    assert (groups[last]["class_id"], groups[last]["group_id"]) == (last, last)


def test_many_copies_make_no_candidates(spark):
    t = words(random.Random(9), 50)
    nd = NearDuplicates(corpus(spark, [(i, t) for i in range(300)]), "entry_id", "text")
    assert nd.links().isEmpty() and nd.classes.select("cls").distinct().count() == 1


def test_a_family_of_a_third_of_the_rows_makes_as_many_pairs_as_members(spark):
    rng = random.Random(11)
    base = words(rng, 150).split()
    rows = []
    for i in range(240):
        other = list(base) if i % 3 == 0 else words(rng, 60).split()
        other[rng.randrange(len(other))] = f"edit{i}"
        rows.append((i, " ".join(other)))
    nd = NearDuplicates(corpus(spark, rows), "entry_id", "text")
    star = nd.star()
    assert star.count() < 6 * 80
    near = nd._verified(star).select(F.col("cls_a").alias("u"), F.col("cls_b").alias("v"))
    assert nd.across(components(near), star).count() < 80
    groups = {r["rec"]: r["group_id"] for r in nd.groups().collect()}
    assert {groups[i] for i in range(0, 240, 3)} == {0} and len(set(groups.values())) == 161


def test_groups_are_the_components_of_all_pairs(spark):
    rng, rows = random.Random(12), []
    for _ in range(8):  # chains: each text a few edits further from the first
        text = words(rng, 60).split()
        for _ in range(6):
            text = list(text)
            text[rng.randrange(60)] = f"zz{rng.randrange(999)}"
            rows.append(" ".join(text))
    rows = list(enumerate(rows))
    df = corpus(spark, rows)
    pairs = brute_pairs(rows, 3, 0.75)
    want = components(spark.createDataFrame(sorted(pairs), "u long, v long")).collect()
    groups = {r["rec"]: r["group_id"] for r in NearDuplicates(df, "entry_id", "text", 0.75, 3).groups().collect()}
    assert groups == {i: i for i, _ in rows} | {r["node"]: r["root"] for r in want}


def test_no_text_is_broadcast(spark, capsys):
    nd = NearDuplicates(corpus(spark, near_texts()), "entry_id", "text", 0.7, 3)
    nd.sets_of(spark.createDataFrame([(0, 1), (1, 2)], "a long, b long")).explain()
    assert "Broadcast" not in capsys.readouterr().out


def test_empty_table_has_no_pairs(spark):
    nd = NearDuplicates(corpus(spark, []), "entry_id", "text")
    assert nd.pairs().isEmpty() and nd.groups().isEmpty()


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
