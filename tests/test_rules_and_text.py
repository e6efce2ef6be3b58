import re

import pytest
from pyspark.sql import functions as F

from lexspan.functions import rules, text


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    "t,want",
    [
        ("The board may not act.", "prohibition"), ("No one is allowed; fees are prohibited.", "prohibition"), ("The board SHALL act.", "obligation"),
        ("The act is hereby appropriated.", "obligation"), ("The board may act.", "permission"), ("The board acts.", None), ("Mayor mustang", None), (None, None), ("", None),
    ],
)
def test_signal(spark, t, want):
    assert one(spark, t, rules.signal) == want


@pytest.mark.parametrize(
    "t,kind,date",
    [
        ("NEW SECTION. Sec. 1. This is repealed", "addition", None), ("RCW 1 is amended to read as follows: x", "amendment", None), ("RCW 1 and 2 are each amended to read as follows", "standard", None),
        ("RCW 1 and 2 are each repealed.", "repeal", None), ("This takes effect on July 1, 2026.", "delayed", "on July 1, 2026"), ("The sum of $5 is set aside", "appropriation", None),
    ],
)
def test_section_type(spark, t, kind, date):
    assert tuple(one(spark, t, rules.section_type)) == (kind, date)


def test_temporal(spark):
    t = "Within thirty business days after notice, no later than July 1; once the fee is paid, then file."
    assert one(spark, t, rules.deadlines) == ["Within thirty business days", "no later than July 1"]
    assert one(spark, t, rules.triggers) == ["after notice", "once the fee is paid"]
    assert one(spark, t, rules.sequence) == ["after notice", "then file"]


def test_modal_verb_and_finalize(spark):
    df = spark.createDataFrame([("shall not", None), ("may", "obligation"), ("may", None), (None, "permission"), (None, None)], "m string, s string")
    assert [r[0] for r in df.select(rules.modal_verb(F.col("m"), F.col("s"))).collect()] == ["cannot", "must", "may", "may", "must"]
    assert [one(spark, t, rules.finalize) for t in ("a  b", "x:", None, "")] == ["A b.", "X:", None, None]


def test_entities_in_order(spark):
    assert one(spark, "&amp;lt; &quot;a&quot; &#39;", text.decode) == '< "a" \''
    assert one(spark, "<A>x &amp; y</A><A>z</A>", lambda c: text.xml_tag(c, "A")) == "x & y"
    assert one(spark, "<B/>", lambda c: text.xml_tag(c, "A")) is None
    assert one(spark, "<A>1</A><A>2</A>", lambda c: text.xml_blocks(c, "A")) == ["1", "2"]


def test_html(spark):
    h = "<style>p{}</style><p>One&nbsp;&lt;b&gt;</p>\r\n<div>two<br/>three</div><p></p><p></p><p></p>four"
    assert one(spark, h, text.html_clean) == "One <b>\n\ntwo\nthree\n\nfour"
    assert one(spark, "a <i>b</i>\n c", text.strip_tags) == "a b c"


def test_strike_and_end(spark):
    assert one(spark, "a ((old\ntext)) b", text.strike) == "a b"
    assert one(spark, "x\n--- END ---.\n", lambda c: text.strip_end(F.regexp_replace(c, r"\s+$", ""))) == "x"
    assert one(spark, "x --- END --- y", text.strip_end) == "x --- END --- y"


def test_sections(spark):
    t = "Title\nSec. 1. This is the first section.\n\nNEW SECTION. Sec. 2. And this is the second one.\nSec. 3. Short"
    got = one(spark, t, text.sections)
    assert [(s["sectionNumber"], s["isNewSection"]) for s in got] == [("1", False), ("2", True)]
    assert [s["id"] for s in one(spark, "No heading", text.sections)] == ["section_1"] and one(spark, None, text.sections) is None


@pytest.mark.parametrize("t", ["", "ab", "xabxxab", "ab ab", "é ab 𝔘 ab"])
def test_matches_at(spark, t):
    assert [(m["start"], m["text"]) for m in one(spark, t, lambda c: text.matches_at(c, "a."))] == [(m.start(), m[0]) for m in re.finditer("a.", t)]


def test_sentences_keep_citations(spark):
    assert one(spark, "Under RCW 1.2.3 it applies. The board shall act! (1) And so it goes on.", text.sentences) == ["Under RCW 1.2.3 it applies.", "The board shall act!", "(1) And so it goes on."]
