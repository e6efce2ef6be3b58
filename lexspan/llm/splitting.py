"""Splitting oversized items at natural boundaries, by a recursive hierarchy of separators.

An item is cut into atoms: at section headings, then paragraphs, then sentences, then words, then
characters; a level is only used inside an atom of the level before that is still too long. Atoms
are packed greedily into pieces of at most ``max_chars`` characters. Each piece after the first
starts exactly ``overlap`` characters before the end of the one before, so neighbours share that
many characters, and cutting the overlap off and joining the pieces gives the item back.

Null items have no piece; empty ones and those within the limit come out as one piece. Lengths
count code points. Items are independent rows, so a column of long texts needs no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.runtime import arrow_type

#: Where a level may cut: each match's end is a cut. The last level cuts anywhere.
LEVELS = (
    ("section", re.compile(r"\n+(?=(?:NEW SECTION\.\s+)?Sec\.\s+\d)")),
    ("paragraph", re.compile(r"\n\s*\n\s*|\n(?=\(\w{1,4}\))")),
    ("line", re.compile(r"\n+")),
    ("sentence", re.compile(r"(?<=[.!?;:])[\"”’)]*\s+|[。！？；]+")),
    ("word", re.compile(r"\s+")),
)


def atoms(text: str, start: int, end: int, limit: int, level: int = 0) -> Iterator[tuple[int, int, str]]:
    """(start, end, boundary kind) of the parts of text[start:end], each of at most limit characters."""
    if end - start <= limit:
        yield start, end, LEVELS[level - 1][0] if level else "item"
        return
    if level == len(LEVELS):
        for a in range(start, end, limit):
            yield a, min(a + limit, end), "character"
        return
    kind, pattern = LEVELS[level]
    a = start
    for m in pattern.finditer(text, start, end):
        if a < m.end() < end:
            for x, y, k in atoms(text, a, m.end(), limit, level + 1):
                yield x, y, kind if y == m.end() else k
            a = m.end()
    yield from atoms(text, a, end, limit, level + 1)


def pieces(text: str, max_chars: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, kind of the boundary at the end) of the pieces of the text."""
    out: list[tuple[int, int, str]] = []
    if len(text) <= max_chars:
        return [(0, len(text), "item")]
    start, reach, kind = 0, 0, "item"
    for a, b, k in atoms(text, 0, len(text), max_chars - overlap):
        if b - start > max_chars:
            out.append((start, reach, kind))
            start = reach - overlap
        reach, kind = b, k
    out.append((start, reach, "item"))
    return out


PIECES = "array<struct<piece_no:int,start:int,end:int,cut:string,text:string>>"


def split_items(items: DataFrame, text: Column | str, max_chars: int = 2000, overlap: int = 200) -> DataFrame:
    """Adds the column ``pieces``. Only items over the limit go through Python."""
    if not 0 <= overlap < max_chars:
        raise ValueError("overlap must be at least 0 and less than max_chars")

    kind = arrow_type(PIECES)

    @F.arrow_udf(PIECES)
    def cut(texts: pa.Array) -> pa.Array:
        rows = [t and [{"piece_no": i, "start": a, "end": b, "cut": k, "text": t[a:b]} for i, (a, b, k) in enumerate(pieces(t, max_chars, overlap))] for t in texts.to_pylist()]
        return pa.array(rows, kind)

    text = F.col(text) if isinstance(text, str) else text
    one = F.array(F.struct(F.lit(0).alias("piece_no"), F.lit(0).alias("start"), F.length(text).alias("end"), F.lit("item").alias("cut"), text.alias("text")))
    # One pass over the items; the short ones are null on their way through Python.
    long = F.length(text) > max_chars
    return items.where(text.isNotNull()).withColumn("pieces", F.coalesce(cut(F.when(long, text)), one.cast(PIECES)))


def bill_items(corpus: DataFrame) -> DataFrame:
    """(entry_id, section_pos, item): the sections of each entry, or its text where sections is null."""
    parts = F.when(F.col("sections").isNotNull(), F.expr("transform(sections, s -> s.text)")).otherwise(F.array("text"))
    return corpus.select("entry_id", F.posexplode(parts).alias("section_pos", "item"))


def split_bills(corpus: DataFrame, max_chars: int = 2000, overlap: int = 200) -> DataFrame:
    """One row per item of bill_items that isn't null, with its pieces in order."""
    return split_items(bill_items(corpus), "item", max_chars, overlap)
