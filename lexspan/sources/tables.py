"""Readers of the index, the corpus, harness results, and bulk XML; an absent corpus is an empty one."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.functions.text import trim, xml_block, xml_blocks, xml_tag

INDEX_FIELDS = (
    "bill_id_display bill_id_normalized bill_number chamber title legal_title session status sponsor introducedDate historyLine committee source_url detail_api_path"
).split()
INDEX = ", ".join(f"{c} string" for c in INDEX_FIELDS)
SECTION = "struct<id:string,sectionNumber:string,isNewSection:boolean,text:string,preSourceLog:array<struct<type:string,removed:string,location:string>>>"
CORPUS = f"bill_number string, session string, title string, text string, sections array<{SECTION}>, fetchedAt string, error string"


def read_index(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The bill index: a JSON array of records; with lines, one record a line, which large files can be split at."""
    return spark.read.schema(INDEX).json(path, multiLine=not lines)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The bill corpus: a JSON array of entries; no rows where there is no file or the file is no JSON at all.

    A damaged entry among others stays as a row that says so in ``error``; none vanishes.
    """
    try:
        files = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], CORPUS)
    return corpus_entries(files.select(F.explode(F.from_json("value", "array<string>")).alias("e")).where("e IS NOT NULL"), "e")


def corpus_entries(rows: DataFrame, entry: str) -> DataFrame:
    """Corpus entries of a column of JSON objects; a damaged one says so in ``error``."""
    rows = rows.select(F.from_json(entry, f"{CORPUS}, _damaged string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_damaged"}).alias("r")).select("r.*")
    return rows.withColumn("error", F.when(F.col("_damaged").isNotNull(), F.coalesce("error", F.lit("damaged entry"))).otherwise(F.col("error"))).drop("_damaged")


def read_staged(spark: SparkSession, path: str) -> DataFrame:
    """(name, content): whole files that a download left in a folder, one row each; fetching itself is not done here."""
    rows = spark.read.text(path, wholetext=True).withColumn("name", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    return rows.select("name", F.col("value").alias("content"))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(word): a JSON array of words, lower case, each once."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("word")).select(F.lower(trim(F.col("word"))).alias("word")).where("word <> ''").distinct()


def read_synonyms(spark: SparkSession, path: str, field: str) -> DataFrame:
    """(word, meaning): a map of a JSON object, from a word to one meaning or a list of them."""
    text = F.get_json_object("value", f"$.{field}")
    pairs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(text, "map<string,string>")).alias("word", "m"))
    return pairs.select(F.lower("word").alias("word"), F.explode(F.coalesce(F.from_json(F.when(F.startswith("m", F.lit("[")), F.col("m")), "array<string>"), F.array("m"))).alias("meaning"))


#: Elements of the detail record and of its current status, and the names they come out with (fixed values).
DETAIL = {
    "ShortDescription": "short_description", "LongDescription": "long_description", "LegalTitle": "legal_title", "Request": "request", "IntroducedDate": "introduced_date",
    "Sponsor": "sponsor", "PrimeSponsorID": "prime_sponsor_id", "StateFiscalNote": "state_fiscal_note", "LocalFiscalNote": "local_fiscal_note", "Appropriations": "appropriations",
}
STATUS = {
    "BillId": "bill_id", "HistoryLine": "history_line", "ActionDate": "action_date", "Status": "status",
    "AmendedByOppositeBody": "amended_by_opposite_body", "PartialVeto": "partial_veto", "Veto": "veto", "AmendmentsExist": "amendments_exist",
}


def legislation(staged: DataFrame, xml: str) -> DataFrame:
    """The columns of staged without xml, and one of each element of DETAIL and STATUS; all null where there is no such record.

    The first Legislation block of each file counts, and in it the CurrentStatus block.
    """
    block = xml_block(F.col(xml), "Legislation")
    rest = [c for c in staged.columns if c != xml]
    rows = staged.select(*rest, F.nullif(block, F.lit("")).alias("_b")).withColumn("_s", F.nullif(xml_block(F.col("_b"), "CurrentStatus"), F.lit("")))
    return rows.select(*rest, *[xml_tag(F.col("_b"), t).alias(n) for t, n in DETAIL.items()], *[xml_tag(F.col("_s"), t).alias(n) for t, n in STATUS.items()])


def bulk_records(feed: DataFrame, xml: str) -> DataFrame:
    """Index records of bulk XML: one row per Legislation block that is active and has an id and a number.

    status is the history line, else the status; title the short description, else the legal title,
    else the id.
    """
    block = feed.select(F.explode(xml_blocks(F.col(xml), "LegislationInfo")).alias("x"))
    tag = lambda t: xml_tag(F.col("x"), t)
    some = lambda c: F.nullif(c, F.lit(""))
    got = block.select(
        tag("BillId").alias("bill_id_display"),
        tag("BillNumber").alias("bill_number"),
        tag("OriginalAgency").alias("chamber"),
        tag("Biennium").alias("session"),
        tag("ShortDescription").alias("short"),
        tag("LegalTitle").alias("legal_title"),
        tag("HistoryLine").alias("historyLine"),
        tag("Status").alias("state"),
        tag("Sponsor").alias("sponsor"),
        tag("IntroducedDate").alias("introducedDate"),
        tag("Active").alias("active"),
    )
    got = got.where((F.coalesce(F.lower("active"), F.lit("true")) != "false") & some(F.col("bill_id_display")).isNotNull() & some(F.col("bill_number")).isNotNull())
    return got.select(
        "bill_id_display",
        F.regexp_replace("bill_id_display", r"\s+", "").alias("bill_id_normalized"),
        "bill_number",
        "chamber",
        F.coalesce(some(F.col("short")), some(F.col("legal_title")), F.col("bill_id_display")).alias("title"),
        "legal_title",
        "session",
        F.coalesce(some(F.col("historyLine")), some(F.col("state")), F.lit("")).alias("status"),
        "sponsor",
        "introducedDate",
        "historyLine",
    )


def keep_last(corpus: DataFrame, key: str, order: str) -> DataFrame:
    """Each key's last row in the order, with the order of its first: (columns, first_seen)."""
    rest = [c for c in corpus.columns if c != key]
    return corpus.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r"), F.min(order).alias("first_seen")).select(key, "r.*", "first_seen")


def lexicon(spark: SparkSession, words: dict[str, list[str]]) -> DataFrame:
    """(class, term) of word lists."""
    return spark.createDataFrame([(k, w) for k, v in words.items() for w in v], "class string, term string").withColumn("term", trim(F.col("term")))
