"""Keyword search over the bill index: scoring, expansion, routing, top-k."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspan.functions.text import WS, trim
from lexspan.runtime import materialize

#: Number ranges of record types (fixed values): first and last number, abbreviation, type, chamber.
ROUTES = [
    (1000, 3999, "HB", "House Bill", "House"), (5000, 7999, "SB", "Senate Bill", "Senate"),
    (4000, 4199, "HJM", "House Joint Memorial", "House"), (8000, 8199, "SJM", "Senate Joint Memorial", "Senate"),
    (4200, 4399, "HJR", "House Joint Resolution", "House"), (8200, 8399, "SJR", "Senate Joint Resolution", "Senate"),
    (4400, 4599, "HCR", "House Concurrent Resolution", "House"), (8400, 8599, "SCR", "Senate Concurrent Resolution", "Senate"),
    (4600, 4999, "HR", "House Resolution", "House"), (8600, 8999, "SR", "Senate Resolution", "Senate"),
    (9000, 9999, "SGA", "Senate Gubernatorial Appointment", "Senate"),
]
FIELDS = ["bill_id_display", "bill_id_normalized", "bill_number", "chamber", "title", "session", "status"]


def normalized(c: Column) -> Column:
    """Upper case, only letters A-Z and digits; null as empty."""
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]", "")


def bill_number(c: Column) -> Column:
    """The first number of three or four digits that isn't part of a citation; empty if there is none."""
    return F.coalesce(F.regexp_extract(F.regexp_replace(c, r"(?i)\bRCW\s+[\d.A-Za-z]+", ""), r"\b(\d{3,4})\b", 1), F.lit(""))


def biennium(c: Column, year: int) -> Column:
    """YYYY-YY as it is; a year as the biennium that holds it; anything else as that of ``year``."""
    t = trim(F.coalesce(c, F.lit("")))
    n = F.coalesce(F.regexp_extract(t, r"\A(\d{4})\z", 1).try_cast("int"), F.lit(year))
    start = n - F.pmod(n + 1, F.lit(2))
    return F.when(F.regexp_like(t, F.lit(r"\A\d{4}-\d{2}\z")), t).otherwise(F.concat(start.cast("string"), F.lit("-"), F.lpad(F.pmod(start + 1, F.lit(100)).cast("string"), 2, "0")))


def route(bills: DataFrame, number: str, routes: list[tuple] = ROUTES) -> DataFrame:
    """Adds abbreviation, record_type and chamber of the number's range; "Bill", "Legislative record" and "Unknown" outside of all.

    The ranges are a fixed list, so the range join is a CASE without a join.
    """
    n = F.col(number).try_cast("double")  # "1026.0" is 1026

    def pick(at: int, other: str) -> Column:
        out = None
        for r in routes:
            inside = n.between(r[0], r[1])
            out = F.when(inside, r[at]) if out is None else out.when(inside, r[at])
        return F.lit(other) if out is None else out.otherwise(other)

    return bills.withColumns({"abbreviation": pick(2, "Bill"), "record_type": pick(3, "Legislative record"), "route_chamber": pick(4, "Unknown")})


def corpus_bodies(corpus: DataFrame) -> DataFrame:
    """(bill_number, body): lower-cased section texts of each bill's last entry that has any."""
    body = F.lower(F.array_join(F.transform("sections", lambda s: F.coalesce(s["text"], F.lit(""))), "\n"))
    return corpus.where(F.size("sections") > 0).select("bill_number", "entry_id", body.alias("body")).where("body <> ''").groupBy("bill_number").agg(F.max_by("body", "entry_id").alias("body"))


def score(query: str, fields: list[str], body: str | None = None) -> Column:
    """100 for an equal field, 40 for a prefix, 20 for a part; 10 for each term in a field, 5 for each in the body."""
    q = re.sub("[^A-Z0-9]", "", query.upper())
    terms = query.lower().split()
    plain, low = [normalized(F.col(f)) for f in fields], [F.lower(F.coalesce(F.col(f), F.lit(""))) for f in fields]

    def some(tests: list[Column]) -> Column:
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return out

    points = F.lit(0)
    if q:
        for worth, test in ((100, lambda x: x == q), (40, lambda x: x.startswith(q)), (20, lambda x: x.contains(q))):
            points += F.when(some([test(p) for p in plain]), worth).otherwise(0)
    for t in terms:
        points += F.when(some([x.contains(t) for x in low]), 10).otherwise(0)
        if body:
            points += F.when(F.coalesce(F.col(body), F.lit("")).contains(t), 5).otherwise(0)
    return points


def expand(query: str, phrases: dict[str, str]) -> list[str]:
    """The query and the parent words of the phrases in it, longest phrase first."""
    return [query, *[phrases[p] for p in sorted(phrases, key=len, reverse=True) if p in query.lower()]]


def in_session(session: str, year: int) -> Column:
    """Whether a record's session holds the one asked for, or its biennium."""
    has = F.coalesce("session", F.lit(""))
    return has.contains(session) | F.contains(has, biennium(F.lit(session), year))


def search(index: DataFrame, bodies: DataFrame, query: str, phrases: dict[str, str] | None = None, session: str = "", titles: set[str] | None = None, k: int = 10, year: int = 2026) -> DataFrame:
    """The k best records: (record_id, bill_id_display, title, session, score), by score, display id and record id.

    titles: statute titles that the query's words stand for; a record whose ``rcw_titles`` has one and
    whose score is 0 gets 1. An empty query finds nothing. session keeps records whose session holds it or its
    biennium; one that names no year stands for the biennium of ``year``.
    """
    if not query.strip():
        return index.select("record_id", "bill_id_display", "title", "session", F.lit(0).alias("score")).where("false")
    rows = index.join(bodies, "bill_number", "left")
    best = [score(q, FIELDS, "body") for q in expand(query, phrases or {})]
    points = F.greatest(*best) if len(best) > 1 else best[0]
    if titles and "rcw_titles" in index.columns:
        points = F.when((points == 0) & F.arrays_overlap("rcw_titles", F.array(*[F.lit(t) for t in sorted(titles)])), 1).otherwise(points)
    rows = rows.withColumn("score", points).where("score > 0")
    if session:
        rows = rows.where(in_session(session, year))
    return rows.select("record_id", "bill_id_display", "title", "session", "score").orderBy(F.desc("score"), F.coalesce("bill_id_display", F.lit("")), "record_id").limit(k)


#: Lengths of the beginnings by which parts are looked up in longer strings.
GRAMS = (16, 8, 4, 2, 1)
#: Up to so many parts are sent to all executors as one automaton; more are joined by a shuffle.
FEW_PARTS = 200_000


def contained(parts: DataFrame, wholes: DataFrame, few: int = FEW_PARTS) -> DataFrame:
    """(part, whole) of every part that stands anywhere in a whole; both distinct, of columns part and whole.

    Up to ``few`` parts are looked for at once in each whole, by an automaton of all of them. More are found by a join on
    the beginning of the part, of the greatest length in GRAMS that it has, and each stretch of such a length in the
    whole; the rest is verified. Either way the work grows with the characters of both, not with their product.
    """
    parts = parts.where("part <> ''")
    sent = [r[0] for r in parts.limit(few + 1).collect()]
    if len(sent) <= few:
        return wholes.select("whole").mapInArrow(_scan(sent), "part string, whole string")
    size = F.length("part")
    length = F.coalesce(*[F.when(size >= n, n) for n in GRAMS])
    keyed = parts.withColumn("gram", F.substring(F.col("part"), F.lit(1), length))

    def stretches(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length("whole") - n + 1, F.lit(1)))
        return F.when(F.length("whole") >= n, F.transform(starts, lambda i: F.substring(F.col("whole"), i, F.lit(n))))

    none = F.array().cast("array<string>")
    grams = wholes.select("whole", F.explode(F.array_distinct(F.flatten(F.array(*[F.coalesce(stretches(n), none) for n in GRAMS])))).alias("gram"))
    return grams.join(keyed, "gram").where(F.contains("whole", "part")).select("part", "whole")


def _scan(parts: list[str]):
    schema = pa.schema([("part", pa.string()), ("whole", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, part in enumerate(parts):
            automaton.add_word(part, i)
        if parts:
            automaton.make_automaton()
        for batch in batches:
            out: tuple[list[str], list[str]] = ([], [])
            for whole in batch.column(0).to_pylist() if parts else ():
                found = {i for _, i in automaton.iter(whole)} if whole else ()
                out[0].extend(parts[i] for i in found)
                out[1].extend([whole] * len(found))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string())], schema=schema)

    return run


def search_many(
    index: DataFrame, bodies: DataFrame, queries: DataFrame, phrases: dict[str, str] | None = None, session: str = "", titles: DataFrame | None = None, k: int = 10, year: int = 2026, few: int = FEW_PARTS
) -> DataFrame:
    """The k best records of each of the queries: (query_id, query, record_id, bill_id_display, title, session, score).

    As ``search``, for any number of queries (query_id, query), by an inverted index: the words of fields and bodies that
    hold a term are found once for all queries, and each record's points are summed beside it, so only the k best of a
    partition are shuffled. Up to ``few`` searched terms are sent to the records; more are joined with them. titles: (word, rcw_title), the statute titles that words stand for; with a column titled in
    queries, only for those where it is true.
    """
    split = lambda c: F.filter(F.split(c, WS + "+", -1), lambda w: w != "")
    if session:
        index = index.where(in_session(session, year))
    asked = queries.where(F.length(trim(F.col("query"))) > 0)
    low = F.lower("query")
    parents = [F.when(low.contains(p), F.lit(phrases[p])) for p in sorted(phrases or {}, key=len, reverse=True)]
    variants = asked.select("query_id", F.posexplode(F.array_compact(F.array("query", *parents))).alias("variant", "v"))
    terms = variants.select("query_id", "variant", F.explode(split(F.lower("v"))).alias("key")).groupBy("query_id", "variant", "key").agg(F.count("*").alias("n"))
    norms = variants.select("query_id", "variant", normalized(F.col("v")).alias("key")).where("key <> ''")
    needs = terms.withColumn("kind", F.lit("term")).unionByName(norms.select("*", F.lit(1).cast("long").alias("n"), F.lit("norm").alias("kind")))

    # (record_id, kind, key, points)
    values = index.select("record_id", F.explode(F.array_compact(F.array(*FIELDS))).alias("field"))
    plain = values.select("record_id", normalized(F.col("field")).alias("whole"))
    found = contained(norms.select(F.col("key").alias("part")).distinct(), plain.select("whole").distinct())
    equal, prefix = F.max(F.when(F.col("whole") == F.col("part"), 100).otherwise(0)), F.max(F.when(F.startswith("whole", "part"), 40).otherwise(0))
    hits = plain.join(found, "whole").groupBy("record_id", F.col("part").alias("key")).agg((equal + prefix + 20).alias("points")).select("record_id", F.lit("norm").alias("kind"), "key", "points")
    said = materialize(bodies.where("bill_number IS NOT NULL").select("bill_number", F.array_distinct(split(F.col("body"))).alias("words")), "body-words")
    field_words, body_words = values.select("record_id", F.explode(split(F.lower("field"))).alias("whole")), said.select("bill_number", F.explode("words").alias("whole"))
    holding = contained(terms.select(F.col("key").alias("part")).distinct(), field_words.select("whole").union(body_words.select("whole")).distinct())
    holding = materialize(holding.withColumnRenamed("part", "key"), "holding-words")
    hits = hits.union(field_words.join(holding, "whole").select("record_id", "key").distinct().select("record_id", F.lit("term"), "key", F.lit(10)))
    in_body = body_words.join(holding, "whole").groupBy("bill_number").agg(F.collect_set("key").alias("keys"))
    hits = hits.union(index.select("record_id", "bill_number").join(in_body, "bill_number").select("record_id", F.lit("term"), F.explode("keys"), F.lit(5)))
    if titles is not None and "rcw_titles" in index.columns:
        whole = variants.where("variant > 0").select("query_id", F.lower("v").alias("word"))
        titled = asked.where("titled").select("query_id") if "titled" in queries.columns else asked.select("query_id")
        words = variants.where("variant = 0").select("query_id", F.explode(split(F.lower("v"))).alias("word")).union(whole)
        words = words.join(titled, "query_id", "left_semi")
        wanted = words.join(titles.select(F.lower("word").alias("word"), F.col("rcw_title").alias("key")), "word").select("query_id", "key").distinct()
        needs = needs.unionByName(wanted.select("query_id", F.lit(0).alias("variant"), "key", F.lit(1).cast("long").alias("n"), F.lit("title").alias("kind")))
        hits = hits.union(index.select("record_id", F.lit("title"), F.explode(F.array_distinct("rcw_titles")), F.lit(0)))

    shown = index.select("record_id", "bill_id_display", "title", "session")
    name = F.coalesce("bill_id_display", F.lit(""))
    each = hits.groupBy("record_id").agg(F.collect_list(F.struct("kind", "key", "points")).alias("hits")).join(shown.select("record_id", name.alias("name")), "record_id")
    wanted = needs.select("query_id", "variant", "kind", "key", "n")
    sent = [tuple(r) for r in wanted.limit(few + 1).collect()]
    if len(sent) <= few:
        # The searches go to the records: each task sums up the points of its records and keeps the k best of each search.
        kind = dict(queries.dtypes)["query_id"]
        best = each.sortWithinPartitions("name", "record_id").mapInArrow(_best(sent, k), f"query_id {kind}, record_id {dict(index.dtypes)['record_id']}, name string, score int")
    else:
        rows = each.select("record_id", "name", F.explode("hits").alias("h")).select("record_id", "name", "h.*")
        points = rows.join(wanted, ["kind", "key"]).groupBy("record_id", "name", "query_id", "variant").agg(F.sum(F.col("points") * F.col("n")).alias("score"))
        # 0 only where nothing but a statute title meets
        best = points.groupBy("query_id", "record_id", "name").agg(F.greatest(F.max("score"), F.lit(1)).cast("int").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "name", "record_id")
    top = best.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n", "name")
    return top.join(asked.select("query_id", "query"), "query_id").join(shown, "record_id").select("query_id", "query", "record_id", "bill_id_display", "title", "session", "score")


def _best(needs: list[tuple], k: int):
    """The k best records of a partition for each search; needs: (query_id, variant, kind, key, n). Records come by name and id, so the earlier of equal points stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        variants = sorted({(q, v) for q, v, *_ in needs})
        place = {x: i for i, x in enumerate(variants)}
        asked = sorted({q for q, _ in variants})
        starts = np.searchsorted([q for q, _ in variants], asked)  # a search's variants stand together
        lists: dict[tuple[str, str], list[tuple[int, int]]] = {}
        for q, v, kind, key, n in needs:
            lists.setdefault((kind, key), []).append((place[q, v], n))
        index = {key: tuple(np.array(c, np.int64) for c in zip(*found)) for key, found in lists.items()}
        least, heaps, seq, schema = np.zeros(len(asked), np.int64), [[] for _ in asked], 0, None
        for batch in batches:
            schema = batch.schema
            for rec, hits, name in zip(*(batch.column(schema.get_field_index(c)).to_pylist() for c in ("record_id", "hits", "name"))):
                met = [(index[h["kind"], h["key"]], h["points"]) for h in hits if (h["kind"], h["key"]) in index]
                if not met:
                    continue
                seq += 1
                at = np.concatenate([m[0][0] for m in met])
                points = np.bincount(at, np.concatenate([m[0][1] * m[1] for m in met]), len(variants)).astype(np.int64)
                some = np.bincount(at, minlength=len(variants)) > 0
                score = np.maximum.reduceat(np.where(some, np.maximum(points, 1), 0), starts)  # 0 only where nothing but a statute title meets
                for i in np.flatnonzero(score > least).tolist():
                    heapq.heappush(heaps[i], (int(score[i]), -seq, rec, name))
                    if len(heaps[i]) > k:
                        heapq.heappop(heaps[i])
                    if len(heaps[i]) == k:
                        least[i] = heaps[i][0][0]
        if schema is not None:
            rows = [(q, rec, name, score) for q, heap in zip(asked, heaps) for score, _, rec, name in heap]
            ids = pa.array([r[0] for r in rows], pa.int64()) if all(isinstance(q, int) for q in asked) else pa.array([r[0] for r in rows])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([r[1] for r in rows], schema.field("record_id").type), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.int32())],
                names=["query_id", "record_id", "name", "score"],
            )

    return run


def dedupe_first(rows: DataFrame, key: Column, *order: Column | str) -> DataFrame:
    """The first row of each key in the order."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def official_first(official: DataFrame, local: DataFrame, k: int = 10) -> DataFrame:
    """Official rows before local ones, one for each session and display id, at most k."""
    both = official.withColumn("_p", F.lit(0)).unionByName(local.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    key = normalized(F.concat(F.coalesce("session", F.lit("")), F.coalesce("bill_id_display", F.lit(""))))
    return dedupe_first(both, key, "_p", F.desc("score")).orderBy("_p", F.desc("score"), "bill_id_display").limit(k).drop("_p")


def title_names(titles: Column) -> Column:
    """Statute titles as they are shown."""
    return F.concat(F.lit("Title "), titles)


def map_record(index: DataFrame) -> DataFrame:
    """Search result rows: index fields, filled up from the routing of the number."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    n = F.coalesce(some("bill_number"), F.nullif(bill_number(F.col("bill_id_display")), F.lit("")))
    rows = route(index.withColumn("_n", n), "_n")
    display = F.coalesce(some("bill_id_display"), F.when(F.col("_n").isNotNull(), F.concat_ws(" ", "abbreviation", "_n")))
    known = F.col("_n").isNotNull()
    return rows.select(
        "record_id",
        display.alias("bill_id_display"),
        F.coalesce(some("bill_id_normalized"), normalized(display)).alias("bill_id_normalized"),
        F.col("_n").alias("bill_number"),
        F.when(known, F.col("abbreviation")).alias("abbreviation"),
        F.when(known, F.col("record_type")).alias("record_type"),
        F.coalesce(some("chamber"), F.when(known, F.col("route_chamber"))).alias("chamber"),
        F.coalesce(some("title"), some("bill_id_display"), F.lit("Untitled")).alias("title"),
        some("session").alias("session"),
        some("status").alias("status"),
        F.lit("local_index").alias("source"),
    )


def adapter(index: DataFrame) -> DataFrame:
    """(record_id, id, prefix, number): the id in upper case without white space, its leading letters and its first digits."""
    i = F.regexp_replace(F.upper(F.coalesce("bill_id_display", F.lit(""))), WS + "+", "")
    return index.select("record_id", i.alias("id"), F.nullif(F.regexp_extract(i, r"\A([A-Z]+)", 1), F.lit("")).alias("prefix"), F.nullif(F.regexp_extract(i, r"(\d+)", 1), F.lit("")).alias("number"))
