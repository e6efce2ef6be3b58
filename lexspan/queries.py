"""Named queries of the core over a folder of Parquet tables, and their SQL.

Each runs over its whole tables. A query without an entry in SQL needs what SQL can't state (ordered
scans with a state, look-around); tests hold it against brute force or fixed cases.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan import cases
from lexspan import oracle as o
from lexspan.core.snapshots import bill_changes
from lexspan.functions import rules, text
from lexspan.operators import documents, harness, search, selection
from lexspan.plans import plain_meaning as plan
from lexspan.runtime import fresh_path, materialize, spread, table
from lexspan.sources import sinks, tables
from lexspan.streaming import sections as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
KEYS = ("entry_id", "section_pos")


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def sections(spark: SparkSession, folder: str) -> DataFrame:
    """(entry_id, bill_number, section_pos, text) of all sections, those of ``text`` where an entry has none."""
    rows = spread(table(spark, folder, "bill_corpus").select("entry_id", "bill_number", text.section_texts(F.col("sections"), F.col("text")).alias("texts")))
    return rows.select("entry_id", "bill_number", F.posexplode("texts").alias("section_pos", "text"))


def sentences(spark: SparkSession, folder: str) -> DataFrame:
    """The sentences of all sections, white space collapsed first, as phrases of the rules may stand over a line break."""
    return sections(spark, folder).select(*KEYS, F.posexplode(text.sentences(text.squeeze(F.col("text")))).alias("pos", "sentence"))


# Training data, general ------------------------------------------------------------------------------


@query(r"""
WITH k AS (
  SELECT snapshot_no, session, regexp_replace(upper(bill_id_display), '[^A-Z0-9]', '', 'g') AS bill_key, delivered_at,
    lower(trim(regexp_replace(coalesce(status, ''), '\s+', ' ', 'g'))) || chr(1)
    || lower(trim(regexp_replace(coalesce(historyLine, ''), '\s+', ' ', 'g'))) || chr(1)
    || lower(trim(regexp_replace(coalesce(committee, ''), '\s+', ' ', 'g'))) AS v
  FROM bill_snapshots WHERE bill_id_display IS NOT NULL AND session IS NOT NULL),
one AS (
  SELECT snapshot_no, session, bill_key, v FROM k WHERE bill_key <> ''
  QUALIFY row_number() OVER (PARTITION BY snapshot_no, session, bill_key ORDER BY delivered_at DESC NULLS LAST) = 1),
snaps AS (SELECT snapshot_no AS n, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS p FROM (SELECT DISTINCT snapshot_no FROM one)),
new AS (SELECT s.n, o.* FROM snaps s JOIN one o ON o.snapshot_no = s.n WHERE s.p IS NOT NULL),
old AS (SELECT s.n, o.* FROM snaps s JOIN one o ON o.snapshot_no = s.p)
SELECT coalesce(a.n, b.n) AS snapshot_no, coalesce(a.session, b.session) AS session, coalesce(a.bill_key, b.bill_key) AS bill_key,
  CASE WHEN b.n IS NULL THEN 'added' WHEN a.n IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM new a FULL JOIN old b ON a.n = b.n AND a.session = b.session AND a.bill_key = b.bill_key
WHERE a.v IS DISTINCT FROM b.v
""")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return bill_changes(table(spark, folder, "bill_snapshots"))


# Sentences and their rules ---------------------------------------------------------------------------


@query(f"WITH {o.SENTENCES} SELECT * FROM sent")
def split_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return sentences(spark, folder)


@query(f"WITH {o.SENTENCES} SELECT entry_id, section_pos, pos, {o.SIGNAL} AS signal FROM sent")
def signal(spark: SparkSession, folder: str) -> DataFrame:
    return sentences(spark, folder).select(*KEYS, "pos", rules.signal(F.col("sentence")).alias("signal"))


@query(f"WITH {o.SENTENCES} SELECT {o.SIGNAL} AS signal, count(*) AS n_sentences, count(DISTINCT entry_id) AS n_entries FROM sent GROUP BY 1")
def signal_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = sentences(spark, folder).select("entry_id", rules.signal(F.col("sentence")).alias("signal"))
    return rows.groupBy("signal").agg(F.count("*").alias("n_sentences"), F.countDistinct("entry_id").alias("n_entries"))


@query(f"""WITH {o.SECTIONS}, t AS (SELECT entry_id, section_pos, text, {o.section_type("text")} AS section_type FROM s WHERE text IS NOT NULL)
SELECT entry_id, section_pos, section_type,
  CASE WHEN section_type = 'delayed' THEN trim(left(trim(regexp_replace({o.first("text", o.DATE, 1)}, '\\s+', ' ', 'g')), 40)) END AS effective_date FROM t""")
def section_type(spark: SparkSession, folder: str) -> DataFrame:
    return sections(spark, folder).where("text IS NOT NULL").select(*KEYS, rules.section_type(F.col("text")).alias("k")).select(*KEYS, F.col("k.type").alias("section_type"), "k.effective_date")


@query(f"WITH {o.SENTENCES} SELECT entry_id, section_pos, pos, rule FROM (SELECT *, {o.PURPOSES} AS rule FROM sent) WHERE rule IS NULL AND {o.SIGNAL} IS NOT NULL")
def constraint_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences with a signal that do more than state a purpose."""
    rows = sentences(spark, folder).where(rules.signal(F.col("sentence")).isNotNull())
    return rows.select(*KEYS, "pos", rules.purpose_rule(F.col("sentence")).alias("rule")).where("rule IS NULL")


@query(f"""WITH {o.SENTENCES} SELECT entry_id, section_pos, pos,
  trim(regexp_replace(regexp_replace(regexp_replace(sentence, '(?i)^\\s*(?:NEW SECTION\\.\\s+)?Sec\\.\\s+\\d+\\.?\\s*', ''), '(?i)^\\s*Section\\s+\\d+[.:)]\\s*', ''), '\\s+', ' ', 'g')) AS normalized FROM sent""")
def normalize(spark: SparkSession, folder: str) -> DataFrame:
    return sentences(spark, folder).select(*KEYS, "pos", rules.normalize(F.col("sentence")).alias("normalized"))


@query(f"WITH {o.SENTENCES} SELECT entry_id, section_pos, pos, {o.MODAL} AS modal FROM sent")
def modal_find(spark: SparkSession, folder: str) -> DataFrame:
    return sentences(spark, folder).select(*KEYS, "pos", rules.modal(F.col("sentence")).alias("modal"))


@query(f"""WITH {o.SENTENCES} SELECT entry_id, section_pos, pos,
  array_to_string(list_concat({o.every("sentence", o.WITHIN)}, {o.every("sentence", r"no later than\s+[^;.]{3,60}")}), '|') AS deadlines,
  array_to_string({o.every("sentence", r"(?:upon|after|following|once)\s+[^,;.]{4,60}")}, '|') AS triggers,
  array_to_string({o.every("sentence", r"(?:before|after|then|prior to|subsequent to)\s+[^,;.]{4,60}")}, '|') AS sequence FROM sent""")
def temporal(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("sentence")
    kinds = {"deadlines": rules.deadlines(s), "triggers": rules.triggers(s), "sequence": rules.sequence(s)}
    return sentences(spark, folder).select(*KEYS, "pos", *[F.array_join(c, "|").alias(n) for n, c in kinds.items()])


@query(f"""WITH {o.SENTENCES}, j AS (SELECT *, CASE WHEN {o.has("sentence", r"\b(?:rcw|revised code of washington|washington state|wa legislature)\b")} THEN 'Washington State' WHEN {o.has("sentence", r"\b(?:congress|federal|u\.s\.|cfr|u\.s\.c\.)\b")} THEN 'Federal' END AS jurisdiction FROM sent)
SELECT entry_id, section_pos, pos, jurisdiction, CASE jurisdiction WHEN 'Washington State' THEN 'wa_legislature' WHEN 'Federal' THEN 'federal_law' END AS system,
  {o.first("sentence", r"\b(?:the\s+)?(?:department|agency|commission|board|office|secretary|director|officer|authority)\s+of\s+[A-Z][A-Za-z\s]{2,40}", 0, "")} AS entity,
  {o.first("sentence", r"\b(?:by|through|via|using|pursuant to)\s+[^,;.]{4,80}")} AS mechanism,
  {o.first("sentence", r"\b(?:penalty|fine|violation|failure to comply|subject to\s+(?:a\s+)?(?:fine|penalty)|enforcement)\b[^.;]*")} AS enforcement FROM j""")
def jurisdiction_and_mechanism(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("sentence")
    return sentences(spark, folder).select(*KEYS, "pos", rules.jurisdiction(s).alias("j"), rules.mechanism(s).alias("mechanism"), rules.enforcement(s).alias("enforcement")).select(*KEYS, "pos", "j.*", "mechanism", "enforcement")


@query(f"""WITH {o.SENTENCES} SELECT entry_id, section_pos, pos,
  array_to_string({o.every("sentence", r"\b(?:may|might|could|likely|possible|probable)\b[^,;.]{0,60}")}, '|') AS likelihood,
  array_to_string({o.every("sentence", r"\b(?:resulting? in|subject to|leading? to|cause[sd]?|consequence)\b[^,;.]{0,60}")}, '|') AS consequences FROM sent""")
def risk(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("sentence")
    return sentences(spark, folder).select(*KEYS, "pos", F.array_join(rules.likelihood(s), "|").alias("likelihood"), F.array_join(rules.consequences(s), "|").alias("consequences"))


@query(f"WITH {o.SENTENCES} SELECT entry_id, section_pos, pos, {o.LENS} AS lens FROM sent")
def lens(spark: SparkSession, folder: str) -> DataFrame:
    return sentences(spark, folder).select(*KEYS, "pos", rules.lens(F.col("sentence"), F.array().cast("array<string>")).alias("lens"))


@query(f"""WITH {o.SENTENCES}, m AS (SELECT entry_id, section_pos, pos, {o.MODAL} AS modal, {o.SIGNAL} AS signal FROM sent)
SELECT entry_id, section_pos, pos, CASE WHEN regexp_matches(coalesce(modal, signal, ''), '(?:shall|must|may) not') OR modal = 'cannot' OR signal = 'prohibition' THEN 'cannot'
  WHEN signal = 'obligation' THEN 'must' WHEN coalesce(modal, signal) = 'may' OR coalesce(modal, signal) LIKE '%permitted%' OR coalesce(modal, signal) LIKE '%authorized%' OR signal = 'permission' THEN 'may' ELSE 'must' END AS verb FROM m""")
def modal_verb(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("sentence")
    return sentences(spark, folder).select(*KEYS, "pos", rules.modal_verb(rules.modal(s), rules.signal(s)).alias("verb"))


@query(f"""WITH {o.SENTENCES}, c AS (SELECT entry_id, section_pos, pos, trim(regexp_replace(sentence, '\\s+', ' ', 'g')) AS s FROM sent)
SELECT entry_id, section_pos, pos, upper(left(s, 1)) || substr(s, 2) || CASE WHEN s LIKE '%.' OR s LIKE '%:' THEN '' ELSE '.' END AS final FROM c""")
def finalize(spark: SparkSession, folder: str) -> DataFrame:
    return sentences(spark, folder).select(*KEYS, "pos", rules.finalize(F.col("sentence")).alias("final"))


# Markup and sections ---------------------------------------------------------------------------------


@query(r"""
WITH p AS (SELECT entry_id, string_split(regexp_replace(text, '(^|\n)([ \t]*(?:NEW SECTION\.\s+)?Sec\.\s+\d+\.)', '\1' || chr(2) || '\2', 'g'), chr(2)) AS l FROM bill_corpus WHERE text IS NOT NULL),
f AS (SELECT entry_id, list_filter(list_transform(l[2:], lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 20) AS f, regexp_replace(array_to_string(l, ''), '^\s+|\s+$', '', 'g') AS whole FROM p),
g AS (SELECT entry_id, CASE WHEN len(f) > 0 THEN f ELSE [whole] END AS f FROM f),
u AS (SELECT entry_id, unnest(range(len(f)))::INT AS section_pos, unnest(f) AS text FROM g)
SELECT entry_id, section_pos, nullif(regexp_extract(text, 'Sec\.\s+(\d+)', 1), '') AS section_number, regexp_matches(text, '^\s*NEW SECTION\.') AS is_new, length(text) AS n_chars FROM u
""")
def section_split(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "bill_corpus").where("text IS NOT NULL").select("entry_id", F.posexplode(text.sections(F.col("text"))).alias("section_pos", "s"))
    return rows.select("entry_id", "section_pos", F.col("s.sectionNumber").alias("section_number"), F.col("s.isNewSection").alias("is_new"), F.length("s.text").alias("n_chars"))


@query(r"""
WITH m AS (SELECT entry_id, regexp_replace(text, '(RCW \d[\d.]*)', '((\1))', 'g') || chr(10) || '---- END ---.' AS t FROM bill_corpus WHERE text IS NOT NULL)
SELECT entry_id, md5(regexp_replace(regexp_replace(regexp_replace(t, '\(\((?s:.*?)\)\)', '', 'g'), '[ \t]{2,}', ' ', 'g'), '\s*-{3,}\s*END\s*-{3,}\s*\.?\s*$', '')) AS digest FROM m
""")
def strike_and_end_strip(spark: SparkSession, folder: str) -> DataFrame:
    """The texts without struck text and end marker; citations are taken as struck, and a marker is put at the end."""
    marked = table(spark, folder, "bill_corpus").where("text IS NOT NULL").select("entry_id", F.concat(struck(F.col("text")), F.lit("\n---- END ---.")).alias("text"))
    return marked.select("entry_id", F.md5(text.strip_end(text.strike(F.col("text")))).alias("digest"))


def struck(c: Column) -> Column:
    return F.regexp_replace(c, r"(RCW \d[\d.]*)", "(($1))")


def escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


#: Labels of a page's documents and their descriptions, by entry_id; the last has no words of its own, so it is described by what is around it.
S_KIND = "list_extract(['Original Bill', 'Second Substitute', 'Engrossed Bill', 'Floor Amendment', 'Fiscal Note', 'Bill Report', 'Digest'], (entry_id % 7)::INT + 1)"
S_EXT = "list_extract(['pdf', 'htm', 'doc'], (entry_id % 3)::INT + 1)"
LABELS, EXTENSIONS = ["Original Bill", "Second Substitute", "Engrossed Bill", "Floor Amendment", "Fiscal Note", "Bill Report", "Digest"], ["pdf", "htm", "doc"]


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Markup made of the texts: paragraphs, breaks, entities, a script, and, far from the text, a link twice to one of seven kinds of documents."""
    one = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), F.pmod("entry_id", F.lit(len(xs))).cast("int") + 1)
    link = F.concat(F.lit('<a class="x" href="/documents/billdocs/'), one(EXTENSIONS), F.lit("/"), F.coalesce("bill_number", F.lit("0")), F.lit("."), one(EXTENSIONS), F.lit('">'), one(LABELS), F.lit("</a><br/>"))
    html = F.concat(
        F.lit("<html><script>var x = 1;</script><body><p>"), F.replace(escaped(F.col("text")), F.lit("\n"), F.lit("</p>\n<p>")), F.lit("</p><div>a&nbsp;&quot;b&quot;</div>"),
        F.repeat(F.lit("- "), F.lit(500)), link, link, F.lit('<a href="mailto:x@y">mail</a></body></html>'),
    )
    return spread(table(spark, folder, "bill_corpus").where("text IS NOT NULL").select("entry_id", "bill_number", "text")).select("entry_id", F.coalesce("bill_number", F.lit("0")).alias("number"), html.alias("html"))


S_LINK = f"""'<a class="x" href="/documents/billdocs/' || {S_EXT} || '/' || coalesce(bill_number, '0') || '.' || {S_EXT} || '">' || {S_KIND} || '</a><br/>'"""
S_PAGES = f"""p AS (SELECT entry_id, coalesce(bill_number, '0') AS number, '<html><script>var x = 1;</script><body><p>' || replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '</p>' || chr(10) || '<p>')
  || '</p><div>a&nbsp;&quot;b&quot;</div>' || repeat('- ', 500) || {S_LINK} || {S_LINK} || '<a href="mailto:x@y">mail</a></body></html>' AS html FROM bill_corpus WHERE text IS NOT NULL)"""
S_DECODE = "replace(replace(replace(replace(replace(replace(replace({}, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&#x27;', '''')"


S_CLEANED = r"""a AS (SELECT entry_id, html, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?i)<br\s*/?>|</p>|</div>|</tr>', chr(10), 'g') AS h FROM p),
b AS (SELECT entry_id, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '<[^>]+>', ' ', 'g'), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS h FROM a),
cleaned AS (SELECT entry_id, html, """ + S_DECODE.format(r"regexp_replace(h, '^\s+|\s+$', '', 'g')") + " AS c FROM b)"


@query(f"WITH {S_PAGES}, {S_CLEANED} SELECT entry_id, md5(c) AS digest FROM cleaned")
def html_clean(spark: SparkSession, folder: str) -> DataFrame:
    return pages(spark, folder).select("entry_id", F.md5(text.html_clean(F.col("html"))).alias("digest"))


@query("WITH " + S_PAGES + ", a AS (SELECT entry_id, " + S_DECODE.format("regexp_replace(html, '<[^>]+>', ' ', 'g')") + r" AS h FROM p) SELECT entry_id, md5(trim(regexp_replace(h, '\s+', ' ', 'g'))) AS digest FROM a")
def strip_tags(spark: SparkSession, folder: str) -> DataFrame:
    return pages(spark, folder).select("entry_id", F.md5(text.strip_tags(F.col("html"))).alias("digest"))


S_URL = f"'https://app.example.gov/documents/billdocs/' || {S_EXT} || '/' || coalesce(bill_number, '0') || '.' || {S_EXT}"


@query(f"""SELECT entry_id, {S_URL} AS url, list_extract(['pdf', 'html', 'word'], (entry_id % 3)::INT + 1) AS file_type, {S_KIND} AS title,
  CASE entry_id % 7 WHEN 6 THEN 'around it' WHEN 1 THEN 'Substitute Bill' WHEN 3 THEN 'Amendment' ELSE {S_KIND} END AS description FROM bill_corpus WHERE text IS NOT NULL""")
def html_links(spark: SparkSession, folder: str) -> DataFrame:
    """The document of each page, linked twice; what stands around a link describes it, here for one kind in seven as a whole."""
    found = documents.links(pages(spark, folder), "entry_id", "html", "https://app.example.gov/", "number")
    around = F.when(F.col("description").endswith("Digest Digest mail") & F.startswith("description", F.lit("- ")), "around it").otherwise(F.col("description"))
    return found.select("entry_id", around.alias("description"), "url", "file_type", "title")


@query(f"SELECT entry_id, {S_URL} AS url FROM bill_corpus WHERE text IS NOT NULL")
def original_doc(spark: SparkSession, folder: str) -> DataFrame:
    found = documents.links(pages(spark, folder), "entry_id", "html", "https://app.example.gov/", "number")
    return documents.original(found, "entry_id").select("entry_id", "url")


@query(f"SELECT entry_id, CASE WHEN entry_id % 3 = 1 THEN {S_URL} END AS url FROM bill_corpus WHERE text IS NOT NULL")
def html_doc_url(spark: SparkSession, folder: str) -> DataFrame:
    """The text in HTML that a search page links to, where it has one."""
    return pages(spark, folder).select("entry_id", documents.document_url(F.col("html"), F.col("number"), "https://app.example.gov/").alias("url"))


@query(r"""
WITH r AS (SELECT *, regexp_replace(bill_id_display, '^\s+|\s+$', '', 'g') AS i, regexp_replace(bill_number, '^\s+|\s+$', '', 'g') AS n,
  nullif(regexp_replace(historyLine, '^\s+|\s+$', '', 'g'), '') AS h, nullif(regexp_replace(title, '^\s+|\s+$', '', 'g'), '') AS t, nullif(regexp_replace(legal_title, '^\s+|\s+$', '', 'g'), '') AS l,
  nullif(regexp_replace(status, '^\s+|\s+$', '', 'g'), '') AS st FROM bill_index)
SELECT i AS bill_id_display, regexp_replace(i, '\s+', '', 'g') AS bill_id_normalized, n AS bill_number, coalesce(t, l, i) AS title, coalesce(h, st, '') AS status FROM r WHERE i <> '' AND n <> '' AND record_id % 5 <> 0
""")
def xml_bill_info(spark: SparkSession, folder: str) -> DataFrame:
    """The bulk feed: index records written as XML, one in five of them as not active, and parsed again."""
    names = {"BillId": "bill_id_display", "BillNumber": "bill_number", "ShortDescription": "title", "LegalTitle": "legal_title", "HistoryLine": "historyLine", "Status": "status", "Biennium": "session"}

    xml = F.concat(F.lit("<R><LegislationInfo>"), *[element(t, F.col(c)) for t, c in names.items()], F.lit("<Active>"), F.when(F.pmod("record_id", F.lit(5)) == 0, "False").otherwise("true"), F.lit("</Active></LegislationInfo></R>"))
    feed = table(spark, folder, "bill_index").select(xml.alias("xml"))
    return tables.bulk_records(feed, "xml").select("bill_id_display", "bill_id_normalized", "bill_number", "title", "status")


@query("""
WITH s AS (SELECT entry_id, unnest(range(len(sections)))::INT AS section_pos, unnest(sections) AS s FROM bill_corpus WHERE sections IS NOT NULL),
l AS (SELECT entry_id, section_pos, s.sectionNumber AS section_number, unnest(s.preSourceLog) AS p FROM s)
SELECT section_number, p.type AS type, count(*) AS n, sum(length(p.removed)) AS removed_chars FROM l GROUP BY 1, 2
""")
def presource_log(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of the log that the corpus was delivered with; ``presource_build`` makes one."""
    rows = table(spark, folder, "bill_corpus").select(F.explode("sections").alias("s")).select(F.col("s.sectionNumber").alias("section_number"), F.explode("s.preSourceLog").alias("p"))
    return rows.groupBy("section_number", F.col("p.type").alias("type")).agg(F.count("*").alias("n"), F.sum(F.length("p.removed")).alias("removed_chars"))


def element(tag: str, c: Column) -> Column:
    """An XML element; none where the value is null."""
    return F.when(c.isNotNull(), F.concat(F.lit(f"<{tag}>"), F.replace(escaped(c), F.lit('"'), F.lit("&quot;")), F.lit(f"</{tag}>"))).otherwise("")


@query(r"""SELECT record_id, nullif(regexp_replace(title, '^\s+|\s+$', '', 'g'), NULL) AS short_description, regexp_replace(legal_title, '^\s+|\s+$', '', 'g') AS legal_title, regexp_replace(sponsor, '^\s+|\s+$', '', 'g') AS sponsor,
  CASE WHEN record_id % 3 > 0 THEN regexp_replace(bill_id_display, '^\s+|\s+$', '', 'g') END AS bill_id, CASE WHEN record_id % 3 > 0 THEN regexp_replace(status, '^\s+|\s+$', '', 'g') END AS status,
  CASE WHEN record_id % 3 > 0 THEN 'false' END AS veto, NULL::VARCHAR AS request FROM bill_index""")
def xml_legislation(spark: SparkSession, folder: str) -> DataFrame:
    """The detail feed: a record for each of the index, one in three without a current status, written as XML and parsed again."""
    state = F.concat(F.lit("<CurrentStatus>"), element("BillId", F.col("bill_id_display")), element("Status", F.col("status")), F.lit("<Veto>false</Veto></CurrentStatus>"))
    parts = [element(t, F.col(c)) for t, c in (("ShortDescription", "title"), ("LegalTitle", "legal_title"), ("Sponsor", "sponsor"))]
    xml = F.concat(F.lit('<A><Legislation id="1">'), *parts, F.when(F.pmod("record_id", F.lit(3)) > 0, state).otherwise(""), F.lit("</Legislation></A>"))
    found = tables.legislation(table(spark, folder, "bill_index").select("record_id", xml.alias("xml")), "xml")
    return found.select("record_id", "short_description", "legal_title", "sponsor", "bill_id", "status", "veto", "request")


S_TEXT = rf"""marked AS (SELECT entry_id, regexp_replace(html, '(RCW \d[\d.]*)', '((\1))', 'g') AS html FROM p),
{S_CLEANED.replace("FROM p)", "FROM marked)")},
left_text AS (SELECT entry_id, html, c, regexp_replace({o.trimmed(r"regexp_replace(regexp_replace(c, '\(\((?s:.*?)\)\)', '', 'g'), '[ \t]{2,}', ' ', 'g')")}, '\s*-{{3,}}\s*END\s*-{{3,}}\s*\.?\s*$', '') AS text FROM cleaned),
parts AS (SELECT entry_id, unnest(range(len(l)))::INT AS section_pos, nullif(regexp_extract(unnest(l), 'Sec\.\s+(\d+)', 1), '') AS section_number, len(l) AS n FROM (SELECT entry_id, {o.cut_sections("text")} AS l FROM left_text WHERE length(text) > 0))"""


def marked_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages whose citations are taken as struck."""
    return pages(spark, folder).select("entry_id", struck(F.col("html")).alias("html"))


@query(f"WITH {S_PAGES}, {S_TEXT} SELECT entry_id, md5(text) AS digest, n_sections FROM left_text LEFT JOIN (SELECT entry_id, count(*)::INT AS n_sections FROM parts GROUP BY 1) USING (entry_id)")
def bill_text(spark: SparkSession, folder: str) -> DataFrame:
    """The text and the number of sections of each page."""
    return documents.bill_text(marked_pages(spark, folder), "entry_id", "html").select("entry_id", F.md5("text").alias("digest"), F.size("sections").alias("n_sections"))


def s_logged(source: str, head: str, pattern: str, kind: str) -> str:
    """(entry_id, number, type, n, chars): matches by the number of the last heading before them; null before the first."""
    cut = rf"string_split(regexp_replace({source}, '(?i)({head})', chr(2) || '\1', 'g'), chr(2))"
    found = f"regexp_extract_all(seg, '{pattern}')"
    return rf"""SELECT entry_id, nullif(regexp_extract(CASE WHEN i > 1 THEN seg ELSE '' END, '(?i)Sec\.\s+(\d+)', 1), '') AS number, '{kind}' AS type, sum(len({found})) AS n, sum(list_sum(list_transform({found}, lambda x: length(x)))) AS chars
FROM (SELECT entry_id, unnest({cut}) AS seg, unnest(range(1, len({cut}) + 1)) AS i FROM left_text) GROUP BY 1, 2 HAVING sum(len({found})) > 0"""


S_LOG = (
    s_logged("html", r"(?:NEW SECTION\.\s*)?Sec\.\s+\d+\.?", r"(?i)<br\s*/?>|</p>|</div>|</tr>", "structural_break")
    + " UNION ALL " + s_logged("c", r"(?:^|\n)\s*(?:NEW SECTION\.\s*)?Sec\.\s+\d+\.?", r"\(\((?s:.*?)\)\)", "struck_text")
)


@query(f"""WITH {S_PAGES}, {S_TEXT}, log AS ({S_LOG}), alone AS (SELECT entry_id FROM parts WHERE n = 1 AND section_number IS NULL)
SELECT entry_id, section_pos, section_number, type, log.n::BIGINT AS n, chars::BIGINT AS removed_chars FROM parts JOIN log USING (entry_id) WHERE section_number = number
UNION ALL SELECT entry_id, NULL, NULL, type, n::BIGINT, chars::BIGINT FROM log WHERE number IS NULL AND entry_id NOT IN (SELECT entry_id FROM alone)
UNION ALL SELECT entry_id, 0, NULL, type, sum(n)::BIGINT, sum(chars)::BIGINT FROM log WHERE entry_id IN (SELECT entry_id FROM alone) GROUP BY 1, 4""")
def presource_build(spark: SparkSession, folder: str) -> DataFrame:
    """How much of the page of each text is deleted before its sections are made, by section and kind; citations are taken as struck."""
    log = documents.presource_log(marked_pages(spark, folder), "entry_id", "html")
    return log.groupBy("entry_id", "section_pos", "section_number", "type").agg(F.count("*").alias("n"), F.sum(F.length("removed")).alias("removed_chars"))


@query(r"""WITH m AS (SELECT entry_id, regexp_replace(text, '(RCW \d[\d.]*)', '((\1))', 'g') AS t FROM bill_corpus WHERE text IS NOT NULL),
l AS (SELECT entry_id, t, regexp_extract_all(t, '\(\((?s:.*?)\)\)') AS found, string_split(regexp_replace(t, '\(\((?s:.*?)\)\)', chr(2), 'g'), chr(2)) AS parts FROM m),
u AS (SELECT entry_id, t, found, parts, unnest(range(1, len(found) + 1)) AS i FROM l),
p AS (SELECT entry_id, t, found[i] AS x, (list_sum(list_transform(parts[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda y: length(y))), 0))::INT AS pos FROM u)
SELECT entry_id, pos, x[3:-3] AS removed, regexp_extract_all(left(t, pos), 'Sec\.\s+(\d+)\.', 1)[-1] AS section_number FROM p""")
def section_asof(spark: SparkSession, folder: str) -> DataFrame:
    """Struck text of each entry with the section it stands in; citations are taken as struck where there is none."""
    marked = table(spark, folder, "bill_corpus").where("text IS NOT NULL").select("entry_id", struck(F.col("text")).alias("text"))
    return documents.struck_sections(marked, "entry_id", "text")


# Selection -------------------------------------------------------------------------------------------

@query(f"WITH {o.SELECTED} SELECT entry_id, section_pos, pos, primary_type, array_to_string(types, '|') AS signal_types, x AS source_span FROM sel")
def sel_units(spark: SparkSession, folder: str) -> DataFrame:
    return selection.units(sections(spark, folder), *KEYS).select(*KEYS, "pos", "primary_type", F.array_join("signal_types", "|").alias("signal_types"), "source_span")


@query("WITH " + o.SELECTED + ", r AS (" + " UNION ALL ".join(f"SELECT entry_id, section_pos, pos, '{n}' AS type, unnest({o.every('x', p)}) AS text FROM sel" for n, p in o.REFERENCES) + ") SELECT * FROM r")
def sel_references(spark: SparkSession, folder: str) -> DataFrame:
    return selection.units(sections(spark, folder), *KEYS).select(*KEYS, "pos", F.explode("references").alias("r")).select(*KEYS, "pos", "r.*")


@query(f"""WITH {o.SELECTED}, n AS (SELECT *, sum(CASE WHEN primary_type IN ('obligation', 'prohibition', 'permission') THEN 1 ELSE 0 END) OVER (PARTITION BY entry_id ORDER BY section_pos, pos) AS rule_no FROM sel)
SELECT entry_id, rule_no::BIGINT AS rule_no, arg_min(primary_type, section_pos * 1000000 + pos) AS rule_type, count(*) AS n_units,
  count(*) FILTER (WHERE list_contains(types, 'condition')) AS n_conditions, count(*) FILTER (WHERE list_contains(types, 'exception')) AS n_exceptions
FROM n WHERE rule_no > 0 GROUP BY 1, 2""")
def sel_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = selection.rules(selection.units(sections(spark, folder), *KEYS), "entry_id", "section_pos")
    return found.select("entry_id", "rule_no", "rule_type", "n_units", F.size("conditions").cast("long").alias("n_conditions"), F.size("exceptions").cast("long").alias("n_exceptions"))


@query(f"WITH {o.SELECTED} SELECT primary_type, count(*) AS n_units FROM sel GROUP BY 1")
def sel_summary(spark: SparkSession, folder: str) -> DataFrame:
    return selection.summary(selection.units(sections(spark, folder), *KEYS))


# Search ----------------------------------------------------------------------------------------------

S_NUMBER = r"coalesce(regexp_extract(regexp_replace({}, '(?i)\bRCW\s+[\d.A-Za-z]+', '', 'g'), '\b(\d{{3,4}})\b', 1), '')"


S_RANGES = f"ranges(lo, hi, abbreviation, record_type, chamber) AS (VALUES {o.RANGES})"


@query(f"""WITH {S_RANGES} SELECT record_id, bill_number, coalesce(abbreviation, 'Bill') AS abbreviation, coalesce(record_type, 'Legislative record') AS record_type, coalesce(ranges.chamber, 'Unknown') AS route_chamber
FROM bill_index LEFT JOIN ranges ON TRY_CAST(bill_number AS DOUBLE) BETWEEN lo AND hi""")
def route(spark: SparkSession, folder: str) -> DataFrame:
    return search.route(table(spark, folder, "bill_index"), "bill_number").select("record_id", "bill_number", "abbreviation", "record_type", "route_chamber")


S_SAID = "CASE record_id % 3 WHEN 0 THEN session WHEN 1 THEN substr(session, 1, 4) ELSE 'next session' END"


@query("WITH r AS (SELECT *, " + o.trimmed(f"coalesce({S_SAID}, '')") + " AS t FROM bill_index), y AS (SELECT *, CASE WHEN regexp_matches(t, '^\\d{4}$') THEN t::INT ELSE 2026 END AS y FROM r) SELECT record_id, " + S_NUMBER.format("bill_id_display") + r""" AS number,
  CASE WHEN regexp_matches(t, '^\d{4}-\d{2}$') THEN t ELSE (y - 1 + y % 2) || '-' || lpad(((y + y % 2) % 100)::VARCHAR, 2, '0') END AS biennium FROM y""")
def query_number_and_biennium(spark: SparkSession, folder: str) -> DataFrame:
    """The bill number in the display id, and the biennium of the session, its first year, or words that name none."""
    rows = table(spark, folder, "bill_index")
    said = F.when(F.pmod("record_id", F.lit(3)) == 0, F.col("session")).when(F.pmod("record_id", F.lit(3)) == 1, F.substring("session", 1, 4)).otherwise("next session")
    return rows.select("record_id", search.bill_number(F.col("bill_id_display")).alias("number"), search.biennium(said, 2026).alias("biennium"))


#: Searches of the query ``search_topk``: the words and the phrases with a parent word.
SEARCHES = ["HB 1552", "tuition credits", "5057", "ferry crossing safety plan"]
PHRASES = {"ferry crossing": "transportation", "safety plan": "safety"}
#: Words and the statute titles they stand for; a deployment reads its own (``tables.read_synonyms``).
TITLE_WORDS = {"tuition": ["Title 28B"], "ferry": ["Title 47"], "safety": ["Title 49", "Title 70"], "parcel": ["Title 58", "Title 84"], "inspection": ["Title 49"]}


def title_words(spark: SparkSession) -> DataFrame:
    return tables.lexicon(spark, TITLE_WORDS).select(F.col("class").alias("word"), F.regexp_replace("term", "^Title ", "").alias("rcw_title"))


S_TITLES = "titles(word, rcw_title) AS (VALUES " + ", ".join(f"({o.quoted(w)}, {o.quoted(t.removeprefix('Title '))})" for w, ts in TITLE_WORDS.items() for t in ts) + ")"


S_BODIES = """b AS (SELECT bill_number, entry_id, lower(array_to_string(list_transform(sections, lambda x: coalesce(x.text, '')), chr(10))) AS body FROM bill_corpus WHERE len(sections) > 0),
bodies AS (SELECT bill_number, arg_max(body, entry_id) AS body FROM b WHERE body <> '' AND bill_number IS NOT NULL GROUP BY 1)"""


@query(f"WITH {S_BODIES} SELECT bill_number, md5(body) AS digest, length(body) AS n_chars FROM bodies")
def corpus_bodies(spark: SparkSession, folder: str) -> DataFrame:
    rows = search.corpus_bodies(table(spark, folder, "bill_corpus")).where("bill_number IS NOT NULL")
    return rows.select("bill_number", F.md5("body").alias("digest"), F.length("body").alias("n_chars"))


_SHOWN = ["bill_id_display", "bill_id_normalized", "bill_number", "chamber", "title", "session", "status"]
S_SEARCH = (
    S_BODIES + ", " + S_TITLES + """,
asked AS (SELECT * FROM (VALUES """ + ", ".join(f"({-1 - i}, {o.quoted(q)}, false)" for i, q in enumerate(SEARCHES)) + """) v(query_id, query, titled)
  UNION ALL SELECT record_id, coalesce(CASE WHEN """ + o.trimmed("title") + """ <> '' THEN title END, CASE WHEN """ + o.trimmed("bill_id_display") + """ <> '' THEN bill_id_display END), true FROM bill_index WHERE record_id % 50 = 0),
phrases(phrase, parent) AS (VALUES """ + ", ".join(f"({o.quoted(p)}, {o.quoted(w)})" for p, w in PHRASES.items()) + """),
said AS (SELECT query_id, query, titled, query AS v FROM asked UNION ALL SELECT query_id, query, titled, parent FROM asked, phrases WHERE contains(lower(query), phrase)),
t AS (SELECT *, regexp_replace(upper(v), '[^A-Z0-9]', '', 'g') AS norm, list_filter(string_split(regexp_replace(lower(v), '\\s+', ' ', 'g'), ' '), lambda x: x <> '') AS terms FROM said),
r AS (SELECT i.*, body, [""" + ", ".join(f"regexp_replace(upper(coalesce({f}, '')), '[^A-Z0-9]', '', 'g')" for f in _SHOWN) + "] AS plain, [" + ", ".join(f"lower(coalesce({f}, ''))" for f in _SHOWN) + """] AS low,
  regexp_extract_all(legal_title, '\\bRCW\\s+(\\d+[A-Za-z]?)\\.', 1) AS cited FROM bill_index i LEFT JOIN bodies USING (bill_number)),
points AS (SELECT query_id, query, record_id, titled, v,
  CASE WHEN norm = '' THEN 0 ELSE (list_contains(plain, norm))::INT * 100 + (len(list_filter(plain, lambda f: starts_with(f, norm))) > 0)::INT * 40 + (len(list_filter(plain, lambda f: contains(f, norm))) > 0)::INT * 20 END
  + coalesce(list_sum(list_transform(terms, lambda x: (len(list_filter(low, lambda f: contains(f, x))) > 0)::INT * 10 + contains(coalesce(body, ''), x)::INT * 5)), 0) AS n FROM t, r),
wanted AS (SELECT DISTINCT query_id, rcw_title FROM (SELECT query_id, unnest(terms) AS word FROM t WHERE titled) JOIN titles USING (word)),
boosted AS (SELECT DISTINCT query_id, record_id FROM wanted JOIN (SELECT record_id, unnest(cited) AS rcw_title FROM r) USING (rcw_title)),
best AS (SELECT query_id, any_value(query) AS query, record_id, max(n)::INT AS n FROM points GROUP BY 1, 3),
scored AS (SELECT b.query_id, b.query, b.record_id, CASE WHEN b.n = 0 AND x.record_id IS NOT NULL THEN 1 ELSE b.n END AS score FROM best b LEFT JOIN boosted x USING (query_id, record_id)),
top AS (SELECT s.*, i.bill_id_display, i.title, i.session FROM scored s JOIN bill_index i USING (record_id) WHERE score > 0
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coalesce(i.bill_id_display, ''), record_id) <= 10)"""
)


@query(f"WITH {S_SEARCH} SELECT query, record_id, bill_id_display, title, session, score FROM top")
def search_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best records of each search: SEARCHES, and the title (else the display id) of every record whose id is divisible by 50.

    The records' searches also take the statute titles that their words stand for.
    """
    index, bodies = table(spark, folder, "bill_index"), search.corpus_bodies(table(spark, folder, "bill_corpus"))
    fixed = spark.createDataFrame([(-1 - i, q, False) for i, q in enumerate(SEARCHES)], "query_id long, query string, titled boolean")
    some = lambda c: F.when(F.length(text.trim(F.col(c))) > 0, F.col(c))
    own = index.where("record_id % 50 = 0").select("record_id", F.coalesce(some("title"), some("bill_id_display")), F.lit(True))
    titles = title_words(spark)
    cited = index.withColumn("rcw_titles", F.regexp_extract_all("legal_title", F.lit(r"\bRCW\s+(\d+[A-Za-z]?)\."), F.lit(1)))
    found = search.search_many(cited, bodies, fixed.union(own), PHRASES, titles=titles)
    return found.select("query", "record_id", "bill_id_display", "title", "session", "score")


@query("""SELECT record_id, session, bill_id_display FROM (SELECT *, row_number() OVER (PARTITION BY regexp_replace(upper(coalesce(session, '') || coalesce(bill_id_display, '')), '[^A-Z0-9]', '', 'g') ORDER BY record_id) AS n FROM bill_index) WHERE n = 1""")
def dedupe(spark: SparkSession, folder: str) -> DataFrame:
    key = search.normalized(F.concat(F.coalesce("session", F.lit("")), F.coalesce("bill_id_display", F.lit(""))))
    return search.dedupe_first(table(spark, folder, "bill_index"), key, "record_id").select("record_id", "session", "bill_id_display")


@query(f"""WITH {S_RANGES}, m AS (SELECT *, coalesce(nullif(bill_number, ''), nullif({S_NUMBER.format("bill_id_display")}, '')) AS n FROM bill_index),
n AS (SELECT m.*, CASE WHEN n IS NOT NULL THEN coalesce(abbreviation, 'Bill') END AS abbreviation, CASE WHEN n IS NOT NULL THEN coalesce(ranges.chamber, 'Unknown') END AS of_range FROM m LEFT JOIN ranges ON TRY_CAST(n AS DOUBLE) BETWEEN lo AND hi)
SELECT record_id, coalesce(nullif(bill_id_display, ''), abbreviation || ' ' || n) AS bill_id_display, n AS bill_number, abbreviation, coalesce(nullif(chamber, ''), of_range) AS chamber,
  coalesce(nullif(title, ''), nullif(bill_id_display, ''), 'Untitled') AS title, nullif(session, '') AS session FROM n""")
def map_record(spark: SparkSession, folder: str) -> DataFrame:
    return search.map_record(table(spark, folder, "bill_index")).select("record_id", "bill_id_display", "bill_number", "abbreviation", "chamber", "title", "session")


@query(r"""WITH i AS (SELECT record_id, regexp_replace(upper(coalesce(bill_id_display, '')), '[\s\x{a0}]+', '', 'g') AS id FROM bill_index)
SELECT record_id, id, nullif(regexp_extract(id, '^([A-Z]+)', 1), '') AS prefix, nullif(regexp_extract(id, '(\d+)', 1), '') AS number FROM i""")
def adapter_norm(spark: SparkSession, folder: str) -> DataFrame:
    return search.adapter(table(spark, folder, "bill_index"))


@query(f"WITH {S_TITLES}, w AS (SELECT record_id, unnest(string_split(lower(title), ' ')) AS word FROM bill_index) SELECT DISTINCT record_id, rcw_title FROM w JOIN titles USING (word)")
def expand_titles(spark: SparkSession, folder: str) -> DataFrame:
    """The statute titles that the words of each record's title stand for."""
    terms = title_words(spark)
    words = table(spark, folder, "bill_index").select("record_id", F.explode(F.split(F.lower("title"), " ")).alias("word"))
    return words.join(F.broadcast(terms), "word").select("record_id", "rcw_title").distinct()  # a fixed list of words


@query("SELECT record_id, coalesce(CASE WHEN feed = 'detail' THEN nullif(sponsor, '') END, upper(sponsor)) AS sponsor, coalesce(CASE WHEN feed = 'detail' THEN nullif(status, '') END, upper(status)) AS status, CASE WHEN feed = 'detail' THEN 'xml' ELSE 'html' END AS detail_source FROM bill_index")
def detail_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Details from the records of the detail feed, else from the scraped page, told apart here by upper case."""
    index = table(spark, folder, "bill_index")
    page = index.select("record_id", F.upper("sponsor").alias("sponsor"), F.upper("status").alias("status"))
    return documents.detail(index.where("feed = 'detail'"), page, "record_id", ["sponsor", "status"])


S_DAY = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) \d{1,2}"


@query(rf"""
WITH r AS (SELECT record_id, nullif({o.squeezed("sponsor")}, '') AS sponsor, {o.squeezed("historyLine")} AS h FROM bill_index WHERE sponsor IS NOT NULL OR historyLine IS NOT NULL)
SELECT record_id, sponsor, nullif(regexp_extract(h, '\b({S_DAY}) (.+)$', 1), '') AS introduced, CASE WHEN regexp_matches(h, '\b{S_DAY} .+$') THEN regexp_replace(h, '^(?:.* )?({S_DAY}) (.+)$', '\1 — \2') END AS last_action FROM r
""")
def html_history(spark: SparkSession, folder: str) -> DataFrame:
    """Sponsor and dated actions scraped from a page of each record that has either."""
    index = table(spark, folder, "bill_index").where("sponsor IS NOT NULL OR historyLine IS NOT NULL")
    part = lambda before, c, after: F.coalesce(F.concat(F.lit(before), escaped(F.col(c)), F.lit(after)), F.lit(""))
    page = F.concat(part("<p>Sponsors: ", "sponsor", "</p>"), F.lit("<p>Companion: none</p>"), part("<ul><li>", "historyLine", "</li></ul>"))
    return index.select("record_id", documents.history(page).alias("h")).select("record_id", "h.*")


@query("WITH " + S_TITLES + " SELECT word, string_agg('Title ' || rcw_title, '|' ORDER BY rcw_title) AS titles FROM titles GROUP BY word")
def rcw_expansion(spark: SparkSession, folder: str) -> DataFrame:
    """The statute titles of each word, as they are shown."""
    return title_words(spark).groupBy("word").agg(F.array_join(F.sort_array(F.collect_set(search.title_names(F.col("rcw_title")))), "|").alias("titles"))


@query(r"""SELECT record_id, session FROM bill_index WHERE contains(coalesce(session, ''), '2026') OR contains(coalesce(session, ''), '2025-26')""")
def session_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The records of a session that is asked for by its second year."""
    return table(spark, folder, "bill_index").where(search.in_session("2026", 2026)).select("record_id", "session")


@query(f"""WITH {S_SEARCH}, local AS (SELECT record_id, bill_id_display, session, score FROM top WHERE query_id = -1),
official AS (SELECT record_id, bill_id_display, session FROM bill_index WHERE bill_number = '1552'),
both_of AS (SELECT 0 AS p, record_id, bill_id_display, session, 0 AS score FROM official UNION ALL SELECT 1, * FROM local),
one AS (SELECT * FROM both_of QUALIFY row_number() OVER (PARTITION BY regexp_replace(upper(coalesce(session, '') || coalesce(bill_id_display, '')), '[^A-Z0-9]', '', 'g') ORDER BY p, score DESC, record_id) = 1)
SELECT record_id, bill_id_display, session FROM one ORDER BY p, score DESC, bill_id_display, record_id LIMIT 10""")
def official_union(spark: SparkSession, folder: str) -> DataFrame:
    """The best records of a search for a bill number, those of the official table first."""
    index, bodies = table(spark, folder, "bill_index"), search.corpus_bodies(table(spark, folder, "bill_corpus"))
    official = index.where("bill_number = '1552'").select("record_id", "bill_id_display", "session", F.lit(0).alias("score"))
    local = search.search(index, bodies, SEARCHES[0], PHRASES).select("record_id", "bill_id_display", "session", "score")
    return search.official_first(official, local).select("record_id", "bill_id_display", "session")


@query("SELECT count(*) AS index_count, count(*) > 0 AS healthy FROM bill_index")
def health(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "bill_index").agg(F.count("*").alias("index_count"), (F.count("*") > 0).alias("healthy"))


# Harness ---------------------------------------------------------------------------------------------

S_LATEST = """r AS (SELECT * FROM check_results QUALIFY row_number() OVER (PARTITION BY bill_number, session, check_code ORDER BY tested_at DESC NULLS LAST, received_at DESC NULLS LAST, result_id DESC) = 1)"""


@query(f"WITH {S_LATEST} SELECT bill_number, session, check_code, result_id, passed FROM r")
def latest_results(spark: SparkSession, folder: str) -> DataFrame:
    return harness.latest(table(spark, folder, "check_results")).select("bill_number", "session", "check_code", "result_id", "passed")


@query(f"WITH {S_LATEST}, e AS (SELECT check_code, coalesce(passed, false) OR coalesce(xfail, false) AS ok FROM r) SELECT check_code, count(*) FILTER (WHERE ok) AS n_pass, count(*) FILTER (WHERE NOT ok) AS n_fail FROM e GROUP BY 1")
def cum_stats(spark: SparkSession, folder: str) -> DataFrame:
    return harness.statistics(harness.latest(table(spark, folder, "check_results")))


@query(f"WITH {S_LATEST} SELECT result_id, 'expected failure: ' || coalesce(reason, 'no reason') AS note FROM r WHERE coalesce(xfail, false) AND NOT coalesce(passed, false)")
def xfail(spark: SparkSession, folder: str) -> DataFrame:
    return harness.expected_failures(harness.latest(table(spark, folder, "check_results"))).where("note IS NOT NULL").select("result_id", "note")


S_NUMERIC = r"SELECT DISTINCT TRY_CAST(bill_number AS DOUBLE)::INT AS n FROM bill_index WHERE regexp_matches(bill_number, '^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$') AND TRY_CAST(bill_number AS DOUBLE) = floor(TRY_CAST(bill_number AS DOUBLE)) AND abs(TRY_CAST(bill_number AS DOUBLE)) < 2147483648"
S_POOL = f"pool AS (SELECT n FROM ({S_NUMERIC}) WHERE n NOT IN (SELECT bill_number::INT FROM sentinel_bills))"


@query(f"WITH {S_POOL} SELECT n FROM pool")
def cov_pool(spark: SparkSession, folder: str) -> DataFrame:
    return harness.coverage_pool(table(spark, folder, "bill_index"), table(spark, folder, "sentinel_bills"))


@query(f"WITH {S_POOL}, o AS (SELECT n, (((row_number() OVER (ORDER BY n) - 1 - 90) % (SELECT count(*) FROM pool)) + (SELECT count(*) FROM pool)) % (SELECT count(*) FROM pool) AS pick_no FROM pool) SELECT n, pick_no::BIGINT AS pick_no FROM o WHERE pick_no < 25")
def cov_sample(spark: SparkSession, folder: str) -> DataFrame:
    return harness.coverage_sample(cov_pool(spark, folder), 90, 25).select("n", F.col("pick_no").cast("long").alias("pick_no"))


@query(f"WITH {S_POOL}, n AS (SELECT count(*) AS n FROM pool) SELECT (90 + 400) % n AS cursor, (90 + 400) // n AS passes FROM n")
def cov_passes(spark: SparkSession, folder: str) -> DataFrame:
    """Where the sample after one of 400 starts, and how often that one went through the pool."""
    return harness.passes(cov_pool(spark, folder), 90, 400)


@query(f"""WITH {S_LATEST}, mine AS (SELECT coalesce(bill_number, '') AS bill_number, check_code, bool_and(coalesce(passed, false)) AS ok FROM r GROUP BY 1, 2),
issues AS (SELECT DISTINCT coalesce(bill_number, '') AS bill_number, v.check_code, 'known since run ' || v.n AS issue FROM check_results, (VALUES ('C1', 1), ('C6', 2), ('never run', 3)) v(check_code, n) WHERE result_id % 3 = 0)
SELECT bill_number, check_code, coalesce(ok, false) OR issue IS NOT NULL AS passed, CASE WHEN NOT coalesce(ok, false) THEN issue END AS note FROM mine FULL JOIN issues USING (bill_number, check_code)""")
def known_issues(spark: SparkSession, folder: str) -> DataFrame:
    """The latest results against known issues of three checks, one of which is never run, for the bills of every third result."""
    rows = table(spark, folder, "check_results").withColumn("bill_number", F.coalesce("bill_number", F.lit("")))
    mine = harness.latest(rows).groupBy("bill_number", "check_code").agg(F.bool_and(F.coalesce("passed", F.lit(False))).alias("passed"))
    codes = F.explode(F.array(*[F.struct(F.lit(c).alias("check_code"), F.lit(f"known since run {n}").alias("reason")) for c, n in (("C1", 1), ("C6", 2), ("never run", 3))])).alias("c")
    issues = rows.where("result_id % 3 = 0").select("bill_number", codes).select("bill_number", "c.*")
    return harness.resolved(mine, issues)


@query("SELECT count(DISTINCT i.bill_number) AS n_bills, (SELECT count(DISTINCT bill_number) FROM check_results) AS n_tested, count(*) AS n_records FROM bill_index i")
def testing_stats(spark: SparkSession, folder: str) -> DataFrame:
    tested = table(spark, folder, "check_results").agg(F.countDistinct("bill_number").alias("n_tested")).withColumn("k", F.lit(1))
    bills = table(spark, folder, "bill_index").agg(F.countDistinct("bill_number").alias("n_bills"), F.count("*").alias("n_records")).withColumn("k", F.lit(1))
    return bills.join(tested, "k").select("n_bills", "n_tested", "n_records")


S_UPSERT = """r AS (SELECT *, run_no = (SELECT max(run_no) FROM check_results) AS is_new FROM check_results),
o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY bill_number, session, check_code, is_new ORDER BY tested_at DESC NULLS LAST, received_at DESC NULLS LAST, result_id DESC) = 1)"""


@query(f"WITH {S_UPSERT} SELECT bill_number, session, check_code, arg_max(result_id, is_new::INT) AS result_id, arg_max(passed, is_new::INT) AS passed FROM o GROUP BY 1, 2, 3")
def sink_results(spark: SparkSession, folder: str) -> DataFrame:
    """The results before the last run, published, and then overwritten by those of the last run."""
    rows = table(spark, folder, "check_results")
    last = rows.agg(F.max("run_no")).first()[0]
    keys, path = ["bill_number", "session", "check_code"], fresh_path(spark, "results")
    for part in (rows.where(F.col("run_no") < F.lit(last)), rows.where(F.col("run_no") == F.lit(last))):
        sinks.publish_upserted(harness.latest(part).select(*keys, "result_id", "passed"), path, keys)
    return sinks.current(spark, path)


@query("SELECT record_id, bill_id_display, session FROM bill_index")
def sink_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index, published; a second delivery, without a record, doesn't replace it."""
    rows, path = table(spark, folder, "bill_index").select("record_id", "bill_id_display", "session"), fresh_path(spark, "index")
    sinks.publish(rows, path)
    sinks.publish(rows.where("false"), path)
    return sinks.current(spark, path)


@query("SELECT bill_number, session, status, count(*) AS n FROM bill_index GROUP BY 1, 2, 3")
def src_json_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index written as JSON and read again."""
    path = fresh_path(spark, "index-json")
    table(spark, folder, "bill_index").select(*tables.INDEX_FIELDS).write.json(path)
    return tables.read_index(spark, path, lines=True).groupBy("bill_number", "session", "status").agg(F.count("*").alias("n"))


@query("SELECT bill_number, session, md5(coalesce(text, '')) AS digest, coalesce(len(sections), 0)::INT AS n_sections, error FROM bill_corpus")
def src_json_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus written as JSON, one file, and read again."""
    path = fresh_path(spark, "corpus-json")
    fields = table(spark, folder, "bill_corpus").select("bill_number", "session", "title", "text", "sections", "fetchedAt", "error")
    # One row of the written table is one array of entries.
    fields.select(F.concat(F.lit("["), F.to_json(F.struct("*")), F.lit("]")).alias("value")).write.text(path)
    lines = spark.read.text(path).select(F.explode(F.from_json("value", "array<string>")).alias("e"))
    return tables.corpus_entries(lines, "e").select("bill_number", "session", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), F.greatest(F.coalesce(F.size("sections"), F.lit(0)), F.lit(0)).alias("n_sections"), "error")


@query("SELECT entry_id, CASE WHEN regexp_matches(error, '(?i)document search failed|bill document fetch failed|fetch failed|ECONNREFUSED|ENOTFOUND|ETIMEDOUT|AbortError|timed? ?out') THEN 'unreachable' ELSE 'error' END AS kind FROM bill_corpus WHERE error IS NOT NULL")
def fetch_kind(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "bill_corpus").where("error IS NOT NULL").select("entry_id", harness.failure_kind(F.col("error")).alias("kind"))


@query("SELECT bill_number, session, max(entry_id) AS entry_id, min(entry_id) AS first_seen FROM bill_corpus GROUP BY 1, 2")
def corpus_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "bill_corpus").withColumn("key", F.struct("bill_number", "session")).select("key", "entry_id", F.col("entry_id").alias("id"))
    return tables.keep_last(rows, "key", "id").select("key.bill_number", "key.session", "entry_id", "first_seen")


# Plain meaning ---------------------------------------------------------------------------------------


def analyzed(spark: SparkSession, folder: str, *fields: str) -> DataFrame:
    rows = sections(spark, folder).where("text IS NOT NULL")
    return plan.plain_meaning(rows, "text", F.col("bill_number").try_cast("int"), fields)


@query()
def plain_meaning(spark: SparkSession, folder: str) -> DataFrame:
    """The plain meaning of every section."""
    fields = ("section_type", "effective_date", "detected_type", "sentence_count", "plain_meaning", "has_content", "empty_reason")
    return analyzed(spark, folder, *fields).select(*KEYS, "result.*")


@query()
def isc_units(spark: SparkSession, folder: str) -> DataFrame:
    """Every instruction: who, must, what, when, where, how, with its sentence."""
    return plan.units(analyzed(spark, folder, "units"), *KEYS)


@query()
def inclusion_lists(spark: SparkSession, folder: str) -> DataFrame:
    return plan.units(analyzed(spark, folder, "units"), *KEYS).where("split_no = 0").select(*KEYS, "unit_no", F.posexplode("inclusion_lists").alias("list_no", "l")).select(*KEYS, "unit_no", "list_no", "l.*")


@query()
def lineage(spark: SparkSession, folder: str) -> DataFrame:
    return plan.lineage(analyzed(spark, folder, "lineage"), *KEYS)


@query()
def trace(spark: SparkSession, folder: str) -> DataFrame:
    """Each sentence's record and its ancestors up to the untouched section."""
    return plan.trace(analyzed(spark, folder, "lineage"), *KEYS).select(*KEYS, "leaf_id", "depth", "record.id", "record.produced_by", "record.start", "record.end")


@query(f"WITH {o.SECTIONS} SELECT entry_id, section_pos, 0::BIGINT AS n_wrong FROM s WHERE text IS NOT NULL")
def chk_L1(spark: SparkSession, folder: str) -> DataFrame:  # noqa: N802
    """Lineage records whose span isn't their text and sentences that aren't located: none in any section."""
    return harness.positions(analyzed(spark, folder, "lineage"), "text", *KEYS).select(*KEYS, "n_wrong")


@query()
def chk_C4(spark: SparkSession, folder: str) -> DataFrame:  # noqa: N802
    """Units whose anchor isn't in their section, and where their lineage leaves it."""
    return harness.anchored(analyzed(spark, folder, "units", "lineage"), "text", *KEYS)


@query(f"WITH {o.SECTIONS} SELECT count(*) AS n, 0::BIGINT AS n_malformed, 0::BIGINT AS n_artefact FROM s WHERE text IS NOT NULL")
def chk_C1_C5(spark: SparkSession, folder: str) -> DataFrame:  # noqa: N802
    rows = plain_meaning(spark, folder)
    return rows.agg(F.count("*").alias("n"), F.count_if(~harness.well_formed(F.col("plain_meaning"))).alias("n_malformed"), F.count_if(harness.dollar_artefact(F.col("plain_meaning"))).alias("n_artefact"))


@query()
def para_anchor(spark: SparkSession, folder: str) -> DataFrame:
    """Every paragraph of every section with the anchor it comes from."""
    return harness.paragraphs(analyzed(spark, folder, "units", "plain_meaning"), *KEYS)


@query()
def chk_C6(spark: SparkSession, folder: str) -> DataFrame:  # noqa: N802
    """Paragraphs that repeat another of their entry, and those that look damaged."""
    parts = materialize(para_anchor(spark, folder), "paragraphs").withColumn("at", F.struct("section_pos", "pos"))
    twice = harness.repeated_paragraphs(parts, "entry_id", "at", "paragraph", "anchor").select("entry_id", "section_pos", "pos", F.lit("duplicate").alias("finding"), "paragraph")
    sign = harness.corruption(F.col("paragraph"))
    return twice.unionByName(parts.select("entry_id", "section_pos", "pos", sign.alias("finding"), "paragraph").where("finding IS NOT NULL"))


S_MARKS = r"(?:\(\d{1,2}\)|\([a-z]\))+"
S_PREAMBLE = rf"""{o.SECTIONS},
t0 AS (SELECT entry_id, section_pos, regexp_replace(text, '(RCW \d[\d.]*)', '((\1))', 'g') AS t0 FROM s WHERE text IS NOT NULL),
t1 AS (SELECT *, regexp_replace(t0, '\(\((?s:.*?)\)\)', '', 'g') AS t1 FROM t0),
t2 AS (SELECT *, {o.squeezed("t1")} AS t2 FROM t1),
t3 AS (SELECT *, regexp_replace(t2, '(?i)^.*?\b(?:is|are\s+each)\s+amended\s+to\s+read\s+as\s+follows\s*:\s*', '') AS t3 FROM t2),
t4 AS (SELECT *, regexp_replace(t3, '(?i)^.*?\b(?:is|are\s+each)\s+added\s+to\s+(?:chapter|the\s+chapter|title)\b.*?\bto\s+read\s+as\s+follows\s*:\s*', '') AS t4 FROM t3),
t5 AS (SELECT *, regexp_replace(t4, '(\.\s+){S_MARKS}\s*', '\1' || chr(1), 'g') AS t5 FROM t4),
t6 AS (SELECT *, regexp_replace(t5, '^{S_MARKS}\s*', '') AS t6 FROM t5),
t7 AS (SELECT *, {o.squeezed("t6", 2)} AS t7 FROM t6)"""
_STEPS = {"root": "t0", "strike": "t1", "white_space": "t2", "amendment_header": "t3", "new_section_header": "t4", "middle_markers": "t5", "leading_markers": "t6", "white_space_runs": "t7"}


def struck_sections(spark: SparkSession, folder: str, *fields: str) -> DataFrame:
    """The analysed sections with citations taken as struck."""
    rows = sections(spark, folder).where("text IS NOT NULL").select(*KEYS, "bill_number", struck(F.col("text")).alias("text"))
    return plan.plain_meaning(rows, "text", F.col("bill_number").try_cast("int"), fields)


@query(f"WITH {S_PREAMBLE} " + " UNION ALL ".join(f"SELECT entry_id, section_pos, '{n}' AS produced_by, md5({t}) AS digest FROM t7" for n, t in _STEPS.items())
       + rf" UNION ALL SELECT entry_id, section_pos, 'marker_skipped', md5(t4) FROM t7 WHERE regexp_matches(t4, '[;:]\s+{S_MARKS}')")
def preamble_steps(spark: SparkSession, folder: str) -> DataFrame:
    """The text of every section after each step of its preamble, from its lineage; citations are taken as struck."""
    rows = plan.lineage(struck_sections(spark, folder, "lineage"), *KEYS).where(F.col("produced_by").isin(*_STEPS, "marker_skipped"))
    return rows.select(*KEYS, "produced_by", F.md5("text").alias("digest"))


@query(f"""WITH {S_PREAMBLE}, l AS (SELECT entry_id, section_pos, list_filter(list_transform({o.split("t7", -1, 'A-Z("' + chr(1))}, lambda x: {o.trimmed("replace(x, chr(1), '')")}), lambda x: length(x) > 15) AS l FROM t7)
SELECT entry_id, section_pos, unnest(range(len(l)))::INT AS pos, unnest(l) AS sentence FROM l""")
def preamble_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """The sentences of every section after its preamble, kept or not, from its lineage; citations are taken as struck."""
    found = F.transform(F.filter("result.lineage", lambda r: r["produced_by"] == "sentence_split"), lambda r: r["text"])
    return struck_sections(spark, folder, "lineage").select(*KEYS, F.posexplode(found).alias("pos", "sentence"))


@query()
def stream_units(spark: SparkSession, folder: str) -> DataFrame:
    """The instructions of a stream of corpus files, run until all that is there has been read."""
    out, state = fresh_path(spark, "stream"), fresh_path(spark, "stream-state")
    found = streaming.corpus_units(spark, f"{folder}/bill_corpus.parquet*", table(spark, folder, "bill_corpus").schema)
    streaming.write(found, out, state).awaitTermination()
    return spark.read.schema(found.schema).parquet(out)


for _family, _sql in cases.FAMILIES.items():
    query(_sql)(_family)

FLAGSHIP = plain_meaning
