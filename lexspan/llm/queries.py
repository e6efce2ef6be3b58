"""Named queries of the operators for training data, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm import languages, mixing
from lexspan.llm.near_duplicates import NearDuplicates
from lexspan.llm.packing import containers, pack
from lexspan.llm.representatives import checked, represent_bills
from lexspan.llm.shared_spans import shared_report, shared_spans
from lexspan.llm.splitting import split_bills
from lexspan.llm.tokens import n_tokens
from lexspan.runtime import materialize, small, spread, table


def limit_of(spark: SparkSession, folder: str, name: str) -> float:
    """A row of job_limits, a table of six rows."""
    return table(spark, folder, "job_limits").where(F.col("limit_name") == name).select("amount").first()[0]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    corpus = table(spark, folder, "bill_corpus")
    spans = shared_spans(corpus, "entry_id", "text", int(limit_of(spark, folder, "shared_span_min")))
    return spans.select(F.col("rec").alias("entry_id"), "span_start", "span_end")


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    """How much of each entry is shared elsewhere."""
    corpus = table(spark, folder, "bill_corpus")
    spans = shared_spans(corpus, "entry_id", "text", int(limit_of(spark, folder, "shared_span_min")))
    return shared_report(corpus, spans, "entry_id", "text").withColumnRenamed("rec", "entry_id")


def _index(spark: SparkSession, folder: str) -> list[DataFrame]:
    return [table(spark, folder, name) for name in ("bill_index", "placeholder_values", "feed_trust")]


def _bills(spark: SparkSession, folder: str) -> DataFrame:
    return represent_bills(*_index(spark, folder))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _bills(spark, folder).where("n_records > 1").select("first_id", "survivor_id", "status_id")


def p2_representatives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per bill, with the values that truth discovery chose."""
    return _bills(spark, folder)


def p2_check(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the representatives of all bills."""
    return checked(*_index(spark, folder))


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    most, overlap = (int(limit_of(spark, folder, n)) for n in ("piece_max", "piece_overlap"))
    return split_bills(table(spark, folder, "bill_corpus"), most, overlap)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder).where(F.size("pieces") > 1).select("entry_id", "section_pos")


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every item, in order."""
    return _pieces(spark, folder).select("entry_id", "section_pos", F.explode("pieces").alias("p")).select("entry_id", "section_pos", "p.*")


def p4_check(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the pieces: none is too long, and without their overlaps they are the item again."""
    most, overlap = (int(limit_of(spark, folder, n)) for n in ("piece_max", "piece_overlap"))
    whole = F.array_join(F.transform("pieces", lambda p, i: F.when(i == 0, p["text"]).otherwise(F.substring(p["text"], F.lit(overlap + 1), F.length(p["text"])))), "")
    long = F.exists("pieces", lambda p: F.length(p["text"]) > most)
    return _pieces(spark, folder).agg(
        F.count("*").alias("n_items"), F.sum(F.length("item")).alias("n_chars"), F.count_if(long).alias("n_too_long"), F.count_if(whole != F.col("item")).alias("n_not_whole")
    )


def _near(spark: SparkSession, folder: str) -> NearDuplicates:
    return NearDuplicates(table(spark, folder, "bill_corpus"), "entry_id", "text", limit_of(spark, folder, "similarity_min"), 3)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _near(spark, folder).pairs().select(F.col("a").alias("entry_id_a"), F.col("b").alias("entry_id_b"))


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each entry with its bill number, its class of equal texts and its group."""
    groups = _near(spark, folder).groups().withColumnRenamed("rec", "entry_id")
    return groups.join(table(spark, folder, "bill_corpus").select("entry_id", "bill_number"), "entry_id")


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every container with its documents (or their parts) and its fill in tokens."""
    capacity = int(limit_of(spark, folder, "container_capacity"))
    sizes = spread(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", n_tokens("text").alias("n_tokens"))
    return containers(pack(sizes, "doc_id", "n_tokens", capacity), capacity)


def p6_check(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the containers: none over its capacity, every document in them with all its tokens, little space unused."""
    capacity = int(limit_of(spark, folder, "container_capacity"))
    sizes = materialize(spread(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", n_tokens("text").alias("n_tokens")), "tokens")
    placed = materialize(pack(sizes, "doc_id", "n_tokens", capacity), "placed")
    got = placed.groupBy(F.col("item").alias("doc_id")).agg(F.sum("part_size").alias("got"), F.sum("part_start").alias("starts"), F.count("*").alias("n"))
    # Parts of an item start at multiples of the capacity, so their sum tells whether each stands there once.
    right = (F.col("got") == F.col("n_tokens")) & (F.col("starts") == F.col("n") * (F.col("n") - 1) / 2 * capacity)
    documents = sizes.where("n_tokens > 0").join(got, "doc_id", "full").agg(F.count("*").alias("n_documents"), F.count_if(~F.coalesce(right, F.lit(False))).alias("n_wrong"))
    full = containers(placed, capacity).agg(F.count_if(F.col("unused") < 0).alias("n_over"), (F.sum("unused") <= F.count("*") * capacity * 0.01 + capacity).alias("little_unused"))
    return documents.withColumn("k", F.lit(1)).join(full.withColumn("k", F.lit(1)), "k").drop("k")


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = spread(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return mixing.choose(docs, "doc_id", "text", "source", n_tokens("text"), table(spark, folder, "mix_targets"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Every chosen document with its count, and the target and reached share of its source."""
    chosen, shares = _mix(spark, folder)
    return chosen.join(shares.select("source", "target_share", "reached_share"), "source").select(
        F.col("doc").alias("doc_id"), "source", F.col("size").alias("n_tokens"), "n_used", "target_share", "reached_share"
    )


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """One row per target source: what it should contribute and what it does."""
    return _mix(spark, folder)[1]


def p7_order(spark: SparkSession, folder: str) -> DataFrame:
    """Every copy of every chosen document, globally shuffled."""
    return mixing.mixture(_mix(spark, folder)[0]).withColumnRenamed("doc", "doc_id")


def p7_check(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the mix: each target of a source with documents met, no document over its cap, each used once in the shares, which sum up to one."""
    chosen, shares = _mix(spark, folder)
    caps = shares.select("source", "max_repeats")
    used = chosen.join(caps, "source", "left").agg(
        F.count_if(F.col("n_used") > F.coalesce("max_repeats", F.lit(0))).alias("n_over"), (F.count("*") - F.countDistinct("doc")).alias("n_twice")
    )
    whole = shares.agg(F.count("*").alias("n_targets"), F.count_if(~F.col("target_met")).alias("n_missed"), (F.abs(F.sum("reached_share") - 1) < 1e-9).alias("sums_to_one"))
    return used.withColumn("k", F.lit(1)).join(whole.withColumn("k", F.lit(1)), "k").drop("k")


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    docs, aliases = table(spark, folder, "documents"), table(spark, folder, "lang_aliases")
    classifier = languages.train(table(spark, folder, "lang_samples"), docs, aliases)
    return languages.label(docs.select("doc_id", "lang", "text"), "text", classifier)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    run_min = int(limit_of(spark, folder, "language_run_min"))
    return languages.wrong_labels(_labelled(spark, folder), table(spark, folder, "lang_aliases"), run_min)


def p8_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Every segment of every document with its language and confidence."""
    return _labelled(spark, folder).select("doc_id", F.posexplode("segments").alias("segment_no", "s")).select("doc_id", "segment_no", "s.*")


def p8_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The language of each document with a confidence."""
    return languages.document_labels(_labelled(spark, folder))


def p8_check(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the labels: segments in order within the text, languages that there are, confidences from 0 to 1.

    mostly_known: of the documents with a known label nine in ten hold its language.
    """
    aliases = table(spark, folder, "lang_aliases")
    langs = [r[0] for r in small(aliases.select("lang").distinct(), 1000)]
    rows = _labelled(spark, folder)
    inside = F.forall("segments", lambda s: (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length("text")) & s["confidence"].between(0, 1) & (s["lang"].isNull() | s["lang"].isin(langs)))
    ordered = F.forall(F.zip_with(F.slice("segments", 1, F.greatest(F.size("segments") - 1, F.lit(0))), F.slice("segments", 2, F.greatest(F.size("segments") - 1, F.lit(0))), lambda a, b: a["end"] <= b["start"]), lambda x: x)
    known = rows.join(F.broadcast(languages.resolved(aliases)), F.lower(F.trim("lang")) == F.col("label_form"), "left").withColumn("_ok", inside & ordered)  # of a fixed table
    right = F.exists("segments", lambda s: s["lang"] == F.col("known_lang"))
    return known.agg(
        F.count("*").alias("n_documents"), F.count("known_lang").alias("n_known"), F.count_if(~F.coalesce("_ok", F.lit(True))).alias("n_wrong"),
        (F.count_if(right) >= F.count("known_lang") * 0.9).alias("mostly_known"),
    )


QUERIES = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p2_found": p2_found,
    "p2_representatives": p2_representatives,
    "p2_check": p2_check,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p4_check": p4_check,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_containers": p6_containers,
    "p6_check": p6_check,
    "p7_check": p7_check,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_order": p7_order,
    "p8_found": p8_found,
    "p8_check": p8_check,
    "p8_segments": p8_segments,
    "p8_documents": p8_documents,
}

_FIELDS = (
    "bill_id_display bill_id_normalized bill_number chamber title legal_title session status sponsor introducedDate historyLine committee source_url detail_api_path"
).split()


def _filled(c: str) -> str:
    v = f"trim(coalesce({c}, ''), ' \t\n\r')"
    return f"(CASE WHEN {v} = '' OR lower({v}) IN (SELECT placeholder FROM placeholder_values) THEN NULL ELSE {v} END)"


_RECORDS = f"""r AS (
  SELECT i.*, trust_rank, {" + ".join(f"({_filled(c)} IS NOT NULL)::INT" for c in _FIELDS)} AS n_filled,
    {_filled("status")} AS st, regexp_extract(session, '[0-9]+')::INT AS y,
    coalesce(nullif(regexp_extract(regexp_replace({_filled("bill_number")}, '\\.0+$', ''), '0*([0-9]+)$', 1), ''),
      regexp_extract({_filled("bill_id_display")}, '0*([0-9]+)$', 1)) AS num
  FROM bill_index i LEFT JOIN feed_trust USING (feed))"""
#: Maximal runs of windows of 300 characters that stand in another entry too.
_SHARED = """w AS (SELECT entry_id, text, unnest(range(length(text) - 299)) AS p FROM bill_corpus WHERE length(text) >= 300),
h AS (SELECT entry_id, p, md5(substr(text, p + 1, 300)) AS h FROM w),
shared AS (SELECT h FROM h GROUP BY 1 HAVING min(entry_id) < max(entry_id)),
m AS (SELECT entry_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY entry_id ORDER BY p) <= 300 THEN 0 ELSE 1 END AS starts FROM h JOIN shared USING (h)),
n AS (SELECT entry_id, p, sum(starts) OVER (PARTITION BY entry_id ORDER BY p) AS run FROM m),
spans AS (SELECT entry_id, min(p)::INT AS span_start, max(p)::INT + 300 AS span_end FROM n GROUP BY entry_id, run)"""
#: Pairs of entries by the sets of three words.
_PAIRS = """w AS (SELECT entry_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM bill_corpus WHERE text IS NOT NULL),
g AS (SELECT DISTINCT entry_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 3),
n AS (SELECT entry_id, count(*) AS n FROM g GROUP BY entry_id),
c AS (SELECT a.entry_id AS a, b.entry_id AS b, count(*) AS both_n FROM g a JOIN g b ON a.s = b.s AND a.entry_id < b.entry_id GROUP BY 1, 2),
pairs AS (SELECT c.a AS entry_id_a, c.b AS entry_id_b FROM c JOIN n x ON x.entry_id = c.a JOIN n y ON y.entry_id = c.b WHERE c.both_n >= 0.7 * (x.n + y.n - c.both_n))"""
SQL = {
    "p2_check": f"WITH {_RECORDS} SELECT count(DISTINCT (y, num)) AS n_bills, count(*) AS n_records, 0::BIGINT AS n_unclaimed, 0::BIGINT AS n_unsupported, 0::BIGINT AS n_moving FROM r WHERE y IS NOT NULL AND num <> ''",
    "p2_found": f"""
WITH {_RECORDS}
SELECT min(record_id) AS first_id,
  arg_min(record_id, (-n_filled, coalesce(trust_rank, 1073741824), -epoch_us(fetched_at), record_id)) AS survivor_id,
  coalesce(arg_min(record_id, (-epoch_us(fetched_at), record_id)) FILTER (WHERE st IS NOT NULL), -1) AS status_id
FROM r GROUP BY y, num HAVING count(*) > 1
""",
    "p4_found": """
WITH items AS (
  SELECT entry_id, unnest(range(len(sections)))::INT AS section_pos, unnest(list_transform(sections, lambda s: s.text)) AS item
  FROM bill_corpus WHERE sections IS NOT NULL
  UNION ALL SELECT entry_id, 0, text FROM bill_corpus WHERE sections IS NULL)
SELECT entry_id, section_pos FROM items WHERE length(item) > 2000
""",
    "p4_check": """
WITH items AS (
  SELECT unnest(list_transform(sections, lambda s: s.text)) AS item FROM bill_corpus WHERE sections IS NOT NULL UNION ALL SELECT text FROM bill_corpus WHERE sections IS NULL)
SELECT count(item) AS n_items, sum(length(item))::BIGINT AS n_chars, 0::BIGINT AS n_too_long, 0::BIGINT AS n_not_whole FROM items
""",
    "p6_check": "SELECT count(*) AS n_documents, 0::BIGINT AS n_wrong, 0::BIGINT AS n_over, true AS little_unused FROM documents WHERE length(text) > 0",
    "p7_check": "SELECT 0::BIGINT AS n_over, 0::BIGINT AS n_twice, count(DISTINCT source) AS n_targets, count(DISTINCT source) FILTER (WHERE target_share > 0 AND source NOT IN (SELECT regexp_replace(lower(trim(regexp_replace(source, '[\\s\\x{a0}]+', ' ', 'g'))), '[ -]+', '_', 'g') FROM documents WHERE length(text) > 0 AND source IS NOT NULL)) AS n_missed, true AS sums_to_one FROM mix_targets",
    "p8_check": "SELECT count(*) AS n_documents, count(l.label_form) AS n_known, 0::BIGINT AS n_wrong, true AS mostly_known FROM documents d LEFT JOIN (SELECT DISTINCT label_form FROM lang_aliases) l ON lower(trim(d.lang)) = l.label_form",
    "p1_found": f"WITH {_SHARED} SELECT entry_id, span_start, span_end FROM spans",
    "p1_report": f"""WITH {_SHARED} SELECT c.entry_id, coalesce(length(text), 0)::INT AS n_chars, coalesce(n, 0) AS n_spans, coalesce(total, 0)::BIGINT AS shared_chars, CASE WHEN length(text) > 0 THEN coalesce(total, 0)::BIGINT / length(text) ELSE 0.0 END AS share
FROM bill_corpus c LEFT JOIN (SELECT entry_id, count(*) AS n, sum(span_end - span_start) AS total FROM spans GROUP BY 1) s USING (entry_id)""",
    "p5_groups": f"""WITH RECURSIVE {_PAIRS},
m AS (SELECT entry_id, md5(string_agg(s, '|' ORDER BY s)) AS digest FROM g GROUP BY 1),
e(x, y) AS (SELECT entry_id_a, entry_id_b FROM pairs UNION SELECT entry_id_b, entry_id_a FROM pairs),
r(x, y) AS (SELECT entry_id, entry_id FROM bill_corpus UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT c.entry_id, c.bill_number, coalesce(min(c.entry_id) OVER (PARTITION BY digest, digest IS NULL, CASE WHEN digest IS NULL THEN c.entry_id END), c.entry_id) AS class_id, q.group_id
FROM bill_corpus c LEFT JOIN m USING (entry_id) JOIN (SELECT x, min(y) AS group_id FROM r GROUP BY 1) q ON q.x = c.entry_id""",
    "p5_found": f"WITH {_PAIRS} SELECT entry_id_a, entry_id_b FROM pairs",
}
