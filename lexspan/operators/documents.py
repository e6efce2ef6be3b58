"""Links of document pages, scraped bill pages, and headings as of a position."""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.functions.rules import has
from lexspan.functions.text import HEADING, decode, html_clean, HTML_ENTITIES, matches_at, sections, strike, strip_end, strip_tags, trim

#: Kinds of documents and the words that tell them, in order (fixed values).
KINDS = [
    ("Original Bill", "original bill"), ("Substitute Bill", "substitute"), ("Engrossed Bill", "engrossed"),
    ("Amendment", "amendment"), ("Fiscal Note", "fiscal note"), ("Bill Report", "bill report"),
]
#: Characters of the page on each side of a link that describe it.
AROUND = 900
ANCHOR = r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']+)[\"'][^>]*>(.*?)</a>"


def absolute(url: Column, base: str) -> Column:
    """The url against the base; null for one of another scheme."""
    host = F.lit(base.split("/")[0] + "//" + base.split("/")[2])
    return (
        F.when(has(url, r"\Ahttps?://"), url)
        .when(url.startswith("//"), F.concat(F.lit(base.split("/")[0]), url))
        .when(url.startswith("/"), F.concat(host, url))
        .when(~has(url, r"\A[a-z][a-z0-9+.-]*:"), F.concat(F.lit(base.rsplit("/", 1)[0] + "/"), url))
    )


def file_type(c: Column) -> Column:
    return F.when(has(c, "pdf"), "pdf").when(has(c, "htm"), "html").when(has(c, r"\.doc|word"), "word").otherwise("document")


def description(around: Column, href: Column) -> Column:
    """The kind of document that its surroundings or its link name, else the surroundings themselves."""
    said = F.concat_ws(" ", around, href)
    out = None
    for name, words in KINDS:
        out = F.when(has(said, words), name) if out is None else out.when(has(said, words), name)
    return out.otherwise(F.coalesce(F.nullif(around, F.lit("")), F.lit("Document")))


def is_bill_document(url: Column, number: Column) -> Column:
    u = F.lower(url)
    return u.contains(number) & has(u, r"lawfilesext\.|billdocs") & has(u, r"\.(?:pdf|htm|doc)")


def links(pages: DataFrame, key: str, html: str, base: str, number: str) -> DataFrame:
    """(key, pos, title, description, url, file_type, source_context): each bill document of a page once, the first kept."""
    h = F.col(html)
    rows = pages.select(key, F.col(number).alias("number"), h.alias("html"), F.explode(matches_at(h, ANCHOR)).alias("a")).select(key, "number", F.col("a.start").alias("pos"), F.col("a.text").alias("a"), "html")
    href = F.regexp_extract("a", ANCHOR, 1)
    rows = rows.withColumn("url", absolute(decode(href, HTML_ENTITIES), base)).withColumn("label", strip_tags(F.regexp_extract("a", ANCHOR, 2)))
    rows = rows.where(is_bill_document(F.col("url"), F.col("number")))
    around = strip_tags(F.expr(f"substring(html, greatest(0, pos - {AROUND}) + 1, length(a) + {AROUND} + least(pos, {AROUND}))"))
    rows = rows.withColumn("around", around).drop("html")
    w = Window.partitionBy(key, "url").orderBy("pos")
    first = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    title = F.coalesce(F.nullif(F.col("label"), F.lit("")), F.concat(F.lit("Bill document "), F.col("number")))
    return first.select(
        key,
        "pos",
        title.alias("title"),
        description(F.col("around"), href).alias("description"),
        "url",
        file_type(F.concat_ws(" ", "url", "label")).alias("file_type"),
        F.substring("around", 1, 700).alias("source_context"),
    )


def document_url(html: Column, number: Column, base: str) -> Column:
    """The first link of a search page to a text in HTML that names the bill, against the base; null if there is none."""
    hrefs = F.transform(F.regexp_extract_all(html, F.lit(r"(?i)<a[^>]+href=\"([^\"]+)\"[^>]*>"), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))
    url = F.try_element_at(F.filter(hrefs, lambda u: F.regexp_like(u, F.lit(r"(?i)\.html?(?:\?|\z)")) & F.contains(u, number)), F.lit(1))
    host = base.split("/")[0] + "//" + base.split("/")[2]
    return F.when(F.startswith(url, F.lit("http")), url).when(url.isNotNull(), F.concat(F.lit(host), url))


def original(documents: DataFrame, key: str) -> DataFrame:
    """Each key's original bill, else its first document."""
    order = F.struct(F.col("description") != "Original Bill", "pos")
    rest = [c for c in documents.columns if c != key]
    return documents.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("d")).select(key, "d.*")


def history(html: Column) -> Column:
    """struct<sponsor, introduced, last_action> of a bill page's dated list of actions."""
    text = strip_tags(html)
    dated = r"\b((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2})\s+(.*?)(?=\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}\s|\z)"
    days, acts = (F.regexp_extract_all(text, F.lit(dated), F.lit(i)) for i in (1, 2))
    last = F.when(F.size(days) > 0, F.concat(F.try_element_at(days, F.lit(-1)), F.lit(" — "), F.try_element_at(acts, F.lit(-1))))
    return F.struct(
        F.nullif(F.regexp_extract(text, r"(?i)Sponsors?:\s*([^:]+?)(?=\s+(?:Companion|Status|Bill|History)|\z)", 1), F.lit("")).alias("sponsor"),
        F.try_element_at(days, F.lit(1)).alias("introduced"),
        last.alias("last_action"),
    )


def struck_sections(corpus: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, removed, section_number): struck text with the last heading at or before it; null before the first.

    The as-of lookup runs inside each row, on the positions of both patterns, without a shuffle.
    """
    t = F.col(text)
    rows = corpus.select(key, matches_at(t, r"\(\([\s\S]*?\)\)").alias("struck"), matches_at(t, rf"(?m){HEADING}").alias("heads"))
    before = F.filter("heads", lambda h: h["start"] <= F.col("s.start"))
    return rows.select(key, "heads", F.explode("struck").alias("s")).select(
        key,
        F.col("s.start").alias("pos"),
        F.regexp_replace("s.text", r"\A\(\(|\)\)\z", "").alias("removed"),
        F.nullif(F.regexp_extract(F.try_element_at(before, F.lit(-1))["text"], r"Sec\.\s+(\d+)", 1), F.lit("")).alias("section_number"),
    )


P_BREAK = re.compile(r"<br\s*/?>|</p>|</div>|</tr>", re.I)
P_STRUCK = re.compile(r"\(\([\s\S]*?\)\)")
P_HTML_HEAD = re.compile(r"(?:NEW SECTION\.\s*)?Sec\.\s+(\d+)\.?", re.I)
P_TEXT_HEAD = re.compile(r"(?:\A|\n)\s*(?:NEW SECTION\.\s*)?Sec\.\s+(\d+)\.?", re.I)


def deletions(html: str | None, cleaned: str | None, numbers: list[str | None]) -> list[tuple]:
    """(section_pos, section_number, log_no, type, removed, location) of what was deleted before the sections were made.

    numbers: those of the sections. What stands before the first heading is the document's, without a section_pos; a
    single section without a number takes all. Sections of the same number share their log, and what stands under a
    number that no section has is in none.
    """
    by_number: dict[str | None, list[tuple]] = {None: []}
    for source, pattern, head, kind in ((html or "", P_BREAK, P_HTML_HEAD, "structural_break"), (cleaned or "", P_STRUCK, P_TEXT_HEAD, "struck_text")):
        heads = [(m.start(), m[1]) for m in head.finditer(source)]
        starts = [h[0] for h in heads]
        for m in pattern.finditer(source):
            at = bisect_right(starts, m.start())
            number = heads[at - 1][1] if at else None
            where = f"raw HTML offset {m.start()}" if kind == "structural_break" else f"{f'Sec. {number}' if at else 'before first section'} (pre-strip offset {m.start()})"
            by_number.setdefault(number, []).append((kind, m[0], where))
    if len(numbers) == 1 and numbers[0] is None:
        logs = [(0, None, [e for log in by_number.values() for e in log])]
    else:
        logs = [(None, None, by_number[None])] + [(i, n, by_number.get(n, [])) for i, n in enumerate(numbers) if n is not None]
    return [(pos, number, i, *e) for pos, number, log in logs for i, e in enumerate(log)]


def presource_log(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, section_pos, section_number, log_no, type, removed, location): the deletions of each page; see ``deletions``.

    Structural breaks are of the raw markup, struck text of the cleaned text. One crossing to Python a page, no shuffle.
    """
    found = F.udf(deletions, "array<struct<section_pos:int,section_number:string,log_no:int,type:string,removed:string,location:string>>", useArrow=True)
    rows = pages.select(key, F.col(html).alias("html"), html_clean(F.col(html)).alias("cleaned"))
    left = strip_end(trim(strike(F.col("cleaned"))))
    numbers = F.when(F.length(left) > 0, F.transform(sections(left), lambda s: s["sectionNumber"])).otherwise(F.array().cast("array<string>"))
    return rows.select(key, F.explode(found("html", "cleaned", numbers)).alias("d")).select(key, "d.*")


def bill_text(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, text, sections, log) of each page: cleaned, struck text and end marker removed, split, with what was deleted.

    sections are array<struct<id, sectionNumber, isNewSection, text, preSourceLog>>; log is what stands before the first
    heading, as ``deletions`` tells. A page without text has none of either.
    """
    kind = "array<struct<section_pos:int,section_number:string,log_no:int,type:string,removed:string,location:string>>"
    found = F.udf(deletions, kind, useArrow=True)
    rows = pages.select(key, F.col(html).alias("html"), html_clean(F.col(html)).alias("cleaned"))
    rows = rows.withColumn("text", strip_end(trim(strike(F.col("cleaned")))))
    rows = rows.withColumn("split", F.when(F.length("text") > 0, sections(F.col("text"))).otherwise(F.array().cast(_SPLIT)))
    rows = rows.withColumn("all", found("html", "cleaned", F.transform("split", lambda s: s["sectionNumber"])))
    entry = lambda e: F.struct(e["type"].alias("type"), e["removed"].alias("removed"), e["location"].alias("location"))
    own = lambda i: F.transform(F.filter("all", lambda e: e["section_pos"] == i), entry)
    with_log = F.transform("split", lambda s, i: F.struct(s["id"].alias("id"), s["sectionNumber"].alias("sectionNumber"), s["isNewSection"].alias("isNewSection"), s["text"].alias("text"), own(i).alias("preSourceLog")))
    return rows.select(key, "text", with_log.alias("sections"), F.transform(F.filter("all", lambda e: e["section_pos"].isNull()), entry).alias("log"))


_SPLIT = "array<struct<id:string,sectionNumber:string,isNewSection:boolean,text:string>>"


def detail(xml: DataFrame, html: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Each field from the XML record, else from the scraped page."""
    a, b = xml.select(key, F.struct(*fields).alias("x")), html.select(key, F.struct(*fields).alias("h"))
    both = a.join(b, key, "full")
    return both.select(key, *[F.coalesce(F.nullif(F.col(f"x.{f}"), F.lit("")), F.col(f"h.{f}")).alias(f) for f in fields], F.when(F.col("x").isNull(), "html").otherwise("xml").alias("detail_source"))
