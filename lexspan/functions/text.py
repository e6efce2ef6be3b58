"""Markup, entities, white space and sections of bill texts, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the source dialect, which Java's \s doesn't cover.
WS = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
#: Entities in the order in which they are decoded (fixed values): &amp; comes first, so &amp;lt; becomes <.
XML_ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))
HTML_ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"))
#: A line that opens a section.
HEADING = r"(?:NEW SECTION\.\s+)?Sec\.\s+\d+\."


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def squeeze(c: Column, least: int = 1) -> Column:
    """Runs of at least ``least`` white space characters as one space, ends trimmed."""
    return trim(F.regexp_replace(c, WS + "{%d,}" % least, " "))


def decode(c: Column, entities=XML_ENTITIES) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), entities, c)


def xml_tag(c: Column, tag: str) -> Column:
    """Decoded, trimmed content of the first element of the name; null if there is none."""
    found = F.regexp_extract(c, f"(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>", 1)
    return F.when(F.regexp_like(c, F.lit(f"(?is)<{tag}(?:\\s[^>]*)?>.*?</{tag}>")), trim(decode(found)))


def xml_block(c: Column, tag: str) -> Column:
    """Raw content of the first element of the name; empty if there is none."""
    return F.coalesce(F.regexp_extract(c, f"(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>", 1), F.lit(""))


def xml_blocks(c: Column, tag: str) -> Column:
    """Raw contents of all elements of the name."""
    return F.regexp_extract_all(c, F.lit(f"(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))


def html_clean(c: Column) -> Column:
    """Text of markup: block ends as line breaks, other tags as spaces, at most one blank line, then decoded."""
    steps = (
        (r"(?is)<(script|style)\b.*?</\1>", " "),
        (r"(?i)<br\s*/?>|</p>|</div>|</tr>", "\n"),
        (r"<[^>]+>", " "),
        (r"\r\n?", "\n"),
        (r"[ \t]+", " "),
        (r" *\n *", "\n"),
        (r"\n{3,}", "\n\n"),
    )
    return decode(trim(reduce(lambda x, s: F.regexp_replace(x, *s), steps, c)), HTML_ENTITIES)


def strip_tags(c: Column) -> Column:
    return squeeze(decode(F.regexp_replace(c, r"<[^>]+>", " "), HTML_ENTITIES))


def strike(c: Column) -> Column:
    """Without struck text in double parentheses."""
    return F.regexp_replace(F.regexp_replace(c, r"\(\([\s\S]*?\)\)", ""), r"[ \t]{2,}", " ")


def strip_end(c: Column) -> Column:
    """Without an end marker at the very end of the document."""
    return F.regexp_replace(c, r"\s*-{3,}\s*END\s*-{3,}\s*\.?\s*\z", "")


def sections(c: Column) -> Column:
    """array<struct<id, sectionNumber, isNewSection, text>>: from each heading line up to the next.

    Sections of 20 characters or less are left out; a text without any is one section. Null gives null.
    """
    pattern = rf"(?ms)^[ \t]*{HEADING}.*?(?=^[ \t]*{HEADING}|\z)"
    found = F.filter(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), trim), lambda s: F.length(s) > 20)
    one = lambda s, i: F.struct(
        F.concat(F.lit("section_"), (i + 1).cast("string")).alias("id"),
        F.nullif(F.regexp_extract(s, r"Sec\.\s+(\d+)", 1), F.lit("")).alias("sectionNumber"),
        F.regexp_like(s, F.lit(r"^\s*NEW SECTION\.")).alias("isNewSection"),
        s.alias("text"),
    )
    return F.when(F.size(found) > 0, F.transform(found, one)).when(c.isNotNull(), F.transform(F.array(trim(c)), one))


def section_texts(split: Column, whole: Column) -> Column:
    """array<string>: the texts of the sections; those of the whole text where there are none, null if that is blank too."""
    return F.when(F.size(split) > 0, F.transform(split, lambda s: s["text"])).when(F.length(trim(whole)) > 0, F.transform(sections(whole), lambda s: s["text"]))


def matches_at(c: Column, pattern: str) -> Column:
    """array<struct<start, text>> of all matches, by interleaving matches and the text between them.

    The pattern must be of positive width and without look-around at its edges.
    """
    texts, gaps = F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.split(c, pattern, -1)
    pairs = F.zip_with(texts, gaps, lambda t, g: F.struct(t.alias("t"), g.alias("g")))
    rows = F.filter(pairs, lambda p: p["t"].isNotNull())
    empty = F.array().cast("array<struct<start:int,text:string>>")
    zero = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    step = lambda acc, p: F.struct(
        (acc["at"] + F.length(p["g"]) + F.length(p["t"])).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(p["g"])).alias("start"), p["t"].alias("text")))).alias("out"),
    )
    return F.aggregate(rows, zero, step, lambda acc: acc["out"])


def sentences(c: Column, least: int = 15, before: str = r'A-Z("') -> Column:
    """Sentences of more than ``least`` characters."""
    parts = F.split(c, r"(?<=[.!?])\s+(?=[" + before + "])", -1)
    return F.filter(F.transform(parts, lambda s: trim(F.replace(s, F.lit("\u0001"), F.lit("")))), lambda s: F.length(s) > least)
