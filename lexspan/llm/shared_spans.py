"""Long exact spans shared between records, by a log-structured index of window hashes.

A batch of records is reduced to selected windows of its texts. Its *places*, one row per window with
the hash of the window (``fp``), the record, the position and a second, independent hash of the
window's context (``cd``), are written as they come, without a shuffle. Its *run* holds one row per
``fp`` with the least and greatest record, aggregated on the map side first, hash-bucketed and sorted
by ``fp``, and never changes. A new run is merge-joined with every older one on ``fp``, so no older
run is shuffled again; an ``fp`` that meets another record is a hit. With more than ``max_runs`` runs
all are compacted into one. As a window that stands in a third of all records is one row of a run,
no bucket is hot; the buckets of a run grow with its rows. The list of runs is a manifest in the
index's folder, so an index can be opened again by another application.

Windows are selected by content: of each ``min_len - window + 1`` consecutive windows those with the
smallest hash. Every span of ``min_len`` characters holds such a group of windows, and equal spans
select equal windows, so no shared span is missed.

``spans`` verifies the hits. The context of a window is all text that a span of ``min_len``
characters over it can reach. Contexts are grouped by (``fp``, ``cd``), 128 bits of two hashes: one of
two records is shared as a whole. Where contexts of one ``fp`` differ, their texts are compared: up to
``CONTEXTS`` different ones directly, with the common text to the left and right of the window giving
the spans that both hold; more of them by keys, each stretch of ``min_len`` characters over the window
being one, and a key of two records (again with the ``fp``, 128 bits) being shared. All of it is
aggregations with a map-side combine and joins with one unique side, so neither pairs of records
nor unbounded groups are made.

Null and empty texts, and those shorter than ``min_len``, share nothing. Records of one id count as
one record. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspan.llm.hashing import U, blocks_of, code_points, mix, prefix_hash, sliding, span_hash
from lexspan.runtime import drop_path, drop_table_files, file_exists, fresh_path, last_file, materialize, read_file, shuffled_by, spread, write_file

#: Characters hashed at once; longer texts go in slices with a margin.
SLICE = 1 << 19
#: Rows of a bucket of a run, about; a run has a power of two of buckets, at least FEWEST.
ROWS_PER_BUCKET, FEWEST = 1 << 20, 8
#: So many different contexts of a window are compared with each other; more by keys.
CONTEXTS = 48
PLACES, RUN = "rec long, fp long, pos int, ahead int, cd long", "fp long, lo long, hi long"


def _select(cp: np.ndarray, ends: np.ndarray, window: int, group: int) -> tuple[np.ndarray, np.ndarray]:
    """Selected window positions and their hashes in texts that stand one after another, ending at ends."""
    n = len(cp) - window + 1
    if n < group:
        return np.empty(0, np.int64), np.empty(0, U)
    prefix = prefix_hash(cp)
    at = np.arange(n)
    h = span_hash(prefix, at, at + window)
    end = np.repeat(ends, np.diff(ends, prepend=0))[:n]
    least = sliding(h, group, np.minimum)
    least[at[: len(least)] + (group - 1 + window) > end[: len(least)]] = 0  # reaches into the next text
    best = sliding(np.pad(least, group - 1), group, np.maximum)
    pos = np.flatnonzero((best == h) & (at + window <= end))
    return pos, h[pos]


def _windows(min_len: int, window: int, size: int):
    slack, margin = min_len - window, 2 * min_len
    schema = pa.schema([("rec", pa.int64()), ("fp", pa.int64()), ("pos", pa.int32()), ("ahead", pa.int32()), ("cd", pa.int64())])

    def pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, str]]:
        """(record, offset of the piece, first position that is the piece's own, text); a margin holds all that own windows depend on."""
        for rec, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for a in range(0, len(text), size):
                lo = max(0, a - margin)
                yield rec, lo, a, text[lo : a + size + margin]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks_of(pieces(batch), lambda p: len(p[3]), size):
                ends = np.cumsum([len(p[3]) for p in block])
                start = np.concatenate([[0], ends[:-1]])
                recs, base, own = (np.array([p[i] for p in block], np.int64) for i in range(3))
                cp = code_points("".join(p[3] for p in block))
                pos, h = _select(cp, ends, window, slack + 1)
                of = np.searchsorted(ends, pos, side="right")
                at = pos - start[of] + base[of]
                mine = (at >= own[of]) & (at < own[of] + size)
                pos, h, of, at = pos[mine], h[mine], of[mine], at[mine]
                left, right = np.maximum(pos - slack, start[of]), np.minimum(pos + window + slack, ends[of])
                cd = mix(span_hash(prefix_hash(cp, 0x5EED), left, right) + (pos - left).astype(U))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(recs[of]), pa.array(h.view(np.int64)), pa.array(at.astype(np.int32)), pa.array((right - pos).astype(np.int32)), pa.array(cd.view(np.int64))],
                    schema=schema,
                )

    return run


class SpanIndex:
    """A log-structured index of the texts of records, in a folder.

    min_len: characters of the shortest span. window: characters of a hashed window; with a longer
    one the index is larger and verification smaller. max_runs: runs kept before compaction. path: the
    index's folder, a new one in the shared folder where none is given; one that holds an index is
    opened as it is, with its min_len and window.
    slice_chars and contexts: SLICE and CONTEXTS.
    """

    def __init__(
        self, spark: SparkSession, min_len: int = 300, window: int | None = None, max_runs: int = 4, path: str | None = None, slice_chars: int = SLICE, contexts: int = CONTEXTS
    ):
        self.spark, self.max_runs, self.slice_chars, self.contexts = spark, max_runs, slice_chars, contexts
        self.path = path or fresh_path(spark, "span-index")
        self.tables: dict[str, str] = {}
        self.state = {"no": 0, "min_len": min_len, "window": window or max(1, min_len * 2 // 3), "runs": [], "places": [], "hits": []}
        newest = last_file(spark, f"{self.path}/manifest")
        if newest:
            self.state = json.loads(read_file(spark, newest))
        self.min_len, self.window = self.state["min_len"], self.state["window"]
        if not 0 < self.window <= self.min_len:
            raise ValueError("window must be between 1 and min_len")

    def _commit(self, **changes: list) -> None:
        """The next manifest; what none names doesn't belong to the index, so a write that was cut off leaves it as it was."""
        self.state = self.state | changes | {"no": self.state["no"] + 1}
        write_file(self.spark, f"{self.path}/manifest/{self.state['no']:09d}", json.dumps(self.state))

    def _run(self, entry: dict) -> DataFrame:
        """A run as a bucketed table; its name in the catalog is only for this session."""
        name = self.tables.get(entry["path"])
        if not name:
            name = self.tables[entry["path"]] = f"span_run_{uuid.uuid4().hex}"
            columns = RUN.replace("long", "bigint")
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {entry['buckets']} BUCKETS LOCATION '{entry['path']}'")
        return self.spark.table(name)

    def _write_run(self, rows: DataFrame, size: int) -> dict:
        """rows (fp, lo, hi) as a run of one row per fp; shuffled once, in as many partitions as there are buckets."""
        buckets = max(FEWEST, 1 << max(0, -(-size // ROWS_PER_BUCKET) - 1).bit_length())
        entry = {"path": f"{self.path}/run-{uuid.uuid4().hex}", "buckets": buckets}
        name = f"span_run_{uuid.uuid4().hex}"
        with shuffled_by(self.spark, buckets):
            one = rows.groupBy("fp").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            one.sortWithinPartitions("fp").write.bucketBy(buckets, "fp").sortBy("fp").option("path", entry["path"]).saveAsTable(name)
        self.tables[entry["path"]] = name
        return entry

    def windows(self, records: DataFrame, rec: str, text: str) -> DataFrame:
        """The selected windows of records, without a shuffle."""
        rows = records.select(F.col(rec).cast("long").alias("rec"), F.col(text).alias("text")).where(F.col("rec").isNotNull() & (F.length("text") >= self.min_len))
        return spread(rows).mapInArrow(_windows(self.min_len, self.window, self.slice_chars), PLACES)

    def ingest(self, records: DataFrame, rec: str, text: str) -> DataFrame:
        """Adds a batch; returns the window hashes that the batch shares within itself or with history."""
        path = f"{self.path}/places-{uuid.uuid4().hex}"
        self.windows(records, rec, text).write.parquet(path)
        return self.ingest_places(path)

    def ingest_places(self, path: str) -> DataFrame:
        """Adds a batch of windows that is already written."""
        places = self.spark.read.schema(PLACES).parquet(path)
        run = self._write_run(places.select("fp", F.col("rec").alias("lo"), F.col("rec").alias("hi")), places.count())
        new = self._run(run)
        found = new.where("lo < hi").select("fp")
        for old in self.state["runs"]:
            before = self._run(old).select("fp", F.col("lo").alias("lo0"), F.col("hi").alias("hi0"))
            met = new.hint("merge").join(before, "fp").where(F.least("lo", "lo0") < F.greatest("hi", "hi0"))
            found = found.union(met.select("fp"))
        hits = f"{self.path}/hits-{uuid.uuid4().hex}"
        found.write.parquet(hits)
        self._commit(runs=[*self.state["runs"], run], places=[*self.state["places"], path], hits=[*self.state["hits"], hits])
        if len(self.state["runs"]) > self.max_runs:
            self.compact()
        return self.spark.read.schema("fp long").parquet(hits).distinct()

    def compact(self) -> None:
        """Merges all runs into one and removes their files; the result of ``spans`` stays the same."""
        old = self.state["runs"]
        rows = None
        for entry in old:
            part = self.spark.read.schema(RUN).parquet(entry["path"])
            rows = part if rows is None else rows.union(part)
        if rows is not None:
            self._commit(runs=[self._write_run(rows, rows.count())])
            self._forget(self.state["runs"][0]["path"])
            for entry in old:
                drop_path(self.spark, entry["path"])

    def _forget(self, *kept: str) -> None:
        for path, name in list(self.tables.items()):
            if path not in kept:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")  # an external table: its files stay
                del self.tables[path]

    def drop(self) -> None:
        """Removes the index and all its files."""
        self._forget()
        drop_path(self.spark, self.path)

    def candidates(self) -> DataFrame:
        """The places of every window whose hash stands in two records."""
        if not self.state["places"]:
            return self.spark.createDataFrame([], PLACES)
        hits = self.spark.read.schema("fp long").parquet(*self.state["hits"]).distinct()
        return self.spark.read.schema(PLACES).parquet(*self.state["places"]).join(hits, "fp", "left_semi").select("rec", "fp", "pos", "ahead", "cd")

    def spans(self, records: DataFrame, rec: str, text: str) -> DataFrame:
        """(rec, span_start, span_end): the maximal runs of shared characters of all ingested records."""
        found = materialize(self.candidates(), "candidates")
        groups = materialize(
            found.groupBy("fp", "cd").agg(F.min(F.struct("rec", "pos")).alias("r"), F.max("rec").alias("hi")).select("fp", "cd", F.col("r.rec").alias("lo"), F.col("r.pos").alias("pos"), "hi"), "groups"
        )
        # Windows with a context of one record only, and how many different contexts they have.
        open_ones = groups.groupBy("fp").agg(F.count("*").alias("n"), F.max(F.col("lo") == F.col("hi")).alias("lonely")).where("lonely AND n > 1").select("fp", "n")
        texts = records.select(F.col(rec).cast("long").alias("rec"), F.col(text).alias("text")).where(F.length("text") >= self.min_len)
        probes = materialize(groups.join(open_ones, "fp"), "probes")
        edges = self._compared(self._contexts(texts, probes.where(F.col("n") <= self.contexts)))
        many = probes.where(F.col("n") > self.contexts)
        if not many.isEmpty():
            edges = edges.union(self._keyed(self._contexts(texts, many)))
        status = groups.where("lo < hi").select("fp", "cd", F.lit(None).cast("int").alias("back"), F.lit(None).cast("int").alias("reach")).union(edges)
        slack = self.min_len - self.window
        covered = found.join(status, ["fp", "cd"]).select(
            "rec", (F.col("pos") - F.coalesce("back", F.least("pos", F.lit(slack)))).alias("a"), (F.col("pos") + F.coalesce("reach", "ahead")).alias("b")
        )
        out = materialize(merge_intervals(covered), "spans")
        for done in (found, groups, probes):
            drop_table_files(done)
        return out

    def _contexts(self, texts: DataFrame, probes: DataFrame) -> DataFrame:
        """(fp, cd, lo, hi, la, ctx) of probes: the context's text, and where in it the window starts."""
        per_rec = probes.groupBy(F.col("lo").alias("rec")).agg(F.collect_list(F.struct("fp", "cd", "pos", "hi")).alias("at"))
        # Merged, as neither side has a bound that would allow a broadcast.
        both = per_rec.hint("merge").join(texts, "rec").select("rec", "text", "at")
        return both.mapInArrow(_cut(self.min_len - self.window, self.min_len), "fp long, cd long, lo long, hi long, la int, ctx string")

    def _compared(self, contexts: DataFrame) -> DataFrame:
        """(fp, cd, back, reach) of contexts of one record: how far spans over the window reach that another record has too."""
        sets = contexts.groupBy("fp").agg(F.collect_list(F.struct("cd", "lo", "hi", "la", "ctx")).alias("c"))  # at most CONTEXTS
        return sets.mapInArrow(_compare(self.window, self.min_len), "fp long, cd long, back int, reach int")

    def _keyed(self, contexts: DataFrame) -> DataFrame:
        """As ``_compared``, for any number of contexts of a window.

        A span of min_len characters that starts ``l`` before the window is a key. First only keys of
        ranges of l are compared, on the characters that all spans of the range have; then every l of
        the ranges that were met in two records.
        """
        slack, full = self.min_len - self.window, self.min_len
        step = max(1, -(-(slack + 1) // 5))
        ranges = F.array(*[F.struct(F.lit(a).alias("from"), F.lit(min(a + step - 1, slack)).alias("to")) for a in range(0, slack + 1, step)])
        coarse = contexts.withColumn("size", F.length("ctx")).withColumn("r", F.explode(ranges)).select("*", F.col("r.from").alias("l0"), F.col("r.to").alias("l1")).drop("r")
        alive = self._met(coarse, full)
        fine = alive.withColumn("l0", F.explode(F.sequence("l0", "l1"))).withColumn("l1", F.col("l0"))
        met = self._met(fine, full).where("lo = hi")
        return met.groupBy("fp", "cd").agg(F.max("l0").alias("back"), (F.lit(full) - F.min("l0")).alias("reach"))

    @staticmethod
    def _met(rows: DataFrame, full: int) -> DataFrame:
        """The rows whose text over [window - l0, window - l1 + full) stands in two records."""
        inside = rows.where(F.expr(f"la >= l0 AND la - l1 + {full} <= size"))
        keyed = inside.withColumn("key", F.expr(f"xxhash64(substring(ctx, la - l0 + 1, {full} - l1 + l0))"))
        shared = keyed.groupBy("fp", "l0", "key").agg(F.min("lo").alias("kl"), F.max("hi").alias("kh")).where("kl < kh").select("fp", "l0", "key")
        return keyed.join(shared, ["fp", "l0", "key"], "left_semi").drop("key")


def _cut(slack: int, reach: int):
    """Contexts of the windows ``at`` of each text; reach: characters from a window's start to its context's end."""
    schema = pa.schema([("fp", pa.int64()), ("cd", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("la", pa.int32()), ("ctx", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text, at = batch.column("text")[i].as_py(), batch.column("at").slice(i, 1).flatten()
                fp, cd, pos, hi = (at.field(n) for n in range(4))
                places = pos.to_pylist()
                rec = pa.array(np.full(len(places), batch.column("rec")[i].as_py(), np.int64))
                la = pa.array([min(p, slack) for p in places], pa.int32())
                yield pa.RecordBatch.from_arrays([fp, cd, rec, hi, la, pa.array([text[max(0, p - slack) : p + reach] for p in places], pa.string())], schema=schema)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Small results together, a few thousand rows each."""
        held: list[pa.RecordBatch] = []
        for b in run(batches):
            held.append(b)
            if sum(x.num_rows for x in held) >= 4096:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return whole


def _common(a: str, b: str) -> int:
    """The length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo = 0
    while lo + 1 < n:
        mid = (lo + n) // 2
        lo, n = (mid, n) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo


def _compare(window: int, full: int):
    slack = full - window
    schema = pa.schema([("fp", pa.int64()), ("cd", pa.int64()), ("back", pa.int32()), ("reach", pa.int32())])

    def edges(contexts: list[dict]) -> Iterator[tuple[int, int, int]]:
        sides = [(c["ctx"][: c["la"]][::-1], c["ctx"][c["la"] + window :]) for c in contexts]
        middle = [c["ctx"][c["la"] : c["la"] + window] for c in contexts]
        out = [[-1, slack + 1] for _ in contexts]  # greatest and least characters before the window of a shared span
        for i, c in enumerate(contexts):
            for j in range(i):
                d = contexts[j]
                if c["lo"] == c["hi"] == d["lo"] == d["hi"] or middle[i] != middle[j]:
                    continue  # both of one record, or windows that only have the same hash
                left, right = _common(sides[i][0], sides[j][0]), _common(sides[i][1], sides[j][1])
                if left + right >= slack:
                    for o in (out[i], out[j]):
                        o[0], o[1] = max(o[0], min(left, slack)), min(o[1], max(0, slack - right))
        for c, (most, least) in zip(contexts, out):
            if most >= 0 and c["lo"] == c["hi"]:
                yield c["cd"], most, full - least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(fp, *e) for fp, c in zip(batch.column("fp").to_pylist(), batch.column("c").to_pylist()) for e in edges(c)]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(list(zip(*rows)) or [[]] * 4, schema)], schema=schema)

    return run


def merge_intervals(rows: DataFrame) -> DataFrame:
    """Joins the intervals [a, b) of each rec that overlap or touch into (rec, span_start, span_end)."""
    order = Window.partitionBy("rec").orderBy("a", "b")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.distinct()
        .withColumn("reach", F.max("b").over(before))
        .withColumn("run", F.sum(F.when(F.col("a") <= F.col("reach"), 0).otherwise(1)).over(order))
        .groupBy("rec", "run")
        .agg(F.min("a").cast("int").alias("span_start"), F.max("b").cast("int").alias("span_end"))
        .drop("run")
    )


def shared_spans(records: DataFrame, rec: str, text: str, min_len: int = 300, batches: int = 5, window: int | None = None, max_runs: int = 3, **limits: int) -> DataFrame:
    """All shared spans of the records, through a fresh index that takes them in batches and is removed at the end.

    The windows of all batches are made in one pass over the texts. With more batches than max_runs the runs are compacted
    on the way.
    """
    index = SpanIndex(records.sparkSession, min_len, window, max_runs, **limits)
    path = f"{index.path}/places"
    index.windows(records, rec, text).withColumn("batch", F.pmod(F.xxhash64("rec"), F.lit(batches)).cast("int")).write.partitionBy("batch").parquet(path)
    for b in range(batches):
        if file_exists(records.sparkSession, f"{path}/batch={b}"):
            index.ingest_places(f"{path}/batch={b}")
    out = index.spans(records, rec, text)
    index.drop()
    return out


def shared_report(records: DataFrame, spans: DataFrame, rec: str, text: str) -> DataFrame:
    """One row per record: its characters, how many of them are shared, and the share.

    A null text has 0 characters; an empty or null text has the share 0.
    """
    total = spans.groupBy("rec").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"), F.count("*").alias("n_spans"))
    sizes = records.select(F.col(rec).cast("long").alias("rec"), F.coalesce(F.length(F.col(text)), F.lit(0)).alias("n_chars"))
    sizes = sizes.groupBy("rec").agg(F.max("n_chars").alias("n_chars"))
    return sizes.join(total, "rec", "left").select(
        "rec",
        "n_chars",
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"),
        F.when(F.col("n_chars") > 0, F.coalesce("shared_chars", F.lit(0)) / F.col("n_chars")).otherwise(F.lit(0.0)).alias("share"),
    )
