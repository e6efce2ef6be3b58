import random

import pytest

from lexspan.functions import kernel as k
from lexspan.functions.rendering import gerund
from lexspan.plans.plain_meaning import Edited, analyze, plain_meaning, trace, units


def test_relative_clause_does_not_set_the_main_signal():
    main, inner = k.signals("The office may grant a permit to a person who shall have filed the form.")
    assert main == "permission" and [(m, s) for m, _, s in inner] == [("who", "obligation")]
    assert k.signals("The board shall meet at that hearing.") == ("obligation", [])


@pytest.mark.parametrize(
    "text,want",
    [
        ("If the fee, as set by rule, is unpaid, the office shall act.", ["If the fee, as set by rule, is unpaid"]),
        ("The office shall act when asked; if not, it waits.", ["if not, it waits", "when asked"]),
        ("The office shall act if asked by July 1, 2025, and the board must agree.", ["if asked by July 1, 2025"]),
        ("The office shall act.", []),
    ],
)
def test_conditions(text, want):
    assert k.conditions(text) == want


def test_two_actors_are_two_instructions():
    a, b = k.instructions("The office shall keep a list, and the board may not change the list.")
    assert (a.actor, a.modal, b.actor, b.modal) == ("The office", "shall", "the board", "may not")
    assert len(k.instructions("The office shall keep a list, and it must publish the list.")) == 1
    assert len(k.instructions("The office shall file by May 15th and send a copy.")) == 1


@pytest.mark.parametrize(
    "text,kind,said",
    [
        ("Fees, including permit fees, apply to all; no one is exempt.", "COMMA_BOUNDED", "including permit fees, apply to all"),
        ("The term (including boats) applies here.", "PARENTHETICAL", "including boats"),
        ("A report including: (a) costs; (b) gains.", "COLON_SUBLIST", None),
        ("The fee covers records, not including copies.", "REVERSED", None),
        ("The owner keeps all records including but not limited to invoices and letters.", "SENTENCE_END", "including but not limited to invoices and letters"),
        ("A list of including terms.", "NOT_A_LIST", None),
    ],
)
def test_inclusion_lists(text, kind, said):
    (one,) = k.inclusions(text)
    assert one.kind == kind and (said is None or text[one.start : one.end] == said)
    assert k.inclusions("The list must include costs.") == []


def test_numeric_marker_closes_a_lettered_list():
    pieces = ["(1) The office shall: (a) Keep a list.", "(b) Publish the list.", "(2) Fees apply to lists.", "(c) Other matter here."]
    assert [bool(b) for b in k.bindings(pieces)] == [False, True, False, False]


def test_values():
    assert k.values("The owner shall act in good faith.") == [("good faith", "open", None, None)]
    assert k.values("The owner shall pay a fee as the board deems equitable.")[0][:3] == ("equitable", "delegated", "the board")
    assert k.values("The owner shall use adequate tools.") == []


def test_coordinate_clauses():
    assert analyze("The office shall keep a list and may not sell the list.")["plain_meaning"] == "The office must keep a list.\n\nThe office cannot sell the list."
    assert gerund("provide a permit") == "providing a permit" and gerund("see it") == "seeing it"


def test_section_prefix_and_empty_sections():
    assert analyze("NEW SECTION. Sec. 2. The board shall adopt the rules.")["plain_meaning"].startswith("New law — The board")
    nothing = analyze("This section is only a short note.")
    assert not nothing["has_content"] and nothing["empty_reason"] == "no_units_supplied" and analyze("")["units"] == []
    assert analyze("The act intends to help; it shall be known as the act.")["units"] == []


def test_edits_map_back():
    rng = random.Random(5)
    for _ in range(200):
        t = "".join(rng.choice("ab  ((x)) .\n(1)") for _ in range(rng.randint(0, 60)))
        e = Edited(t).sub(r"\(\([\s\S]*?\)\)").squeezed(1)
        for i, ch in enumerate(e.text):
            assert t[e.there(i)] == ch or (ch == " " and t[e.there(i)].isspace())


def test_positions_are_faithful_and_long_texts_work():
    t = "((old)) The  board shall\nmeet. (1)(a) The agency may not act on it. " * 3000
    got = analyze(t)
    assert len(got["units"]) == 6000
    for r in got["lineage"]:
        assert r["locate_failed"] or t[r["start"] : r["end"]] == r["text"]
    assert not all(r["locate_failed"] for r in got["lineage"] if r["produced_by"] == "sentence_split")


def test_frames(spark):
    df = spark.createDataFrame([(1, "The board shall adopt rules. The agency may act on them."), (2, None), (3, "")], "doc long, text string")
    rows = plain_meaning(df)
    assert {r["doc"]: r["result"] and r["result"]["sentence_count"] for r in rows.collect()} == {1: 2, 2: None, 3: 0}
    assert [(r["actor"], r["signal"]) for r in units(rows, "doc").orderBy("unit_no").collect()] == [("The board", "obligation"), ("The agency", "permission")]
    walk = trace(rows, "doc").where("doc = 1").collect()
    assert {w["record"]["produced_by"] for w in walk if w["depth"] == 0} == {"sentence_split"} and any(w["record"]["produced_by"] == "root" for w in walk)
