"""Near-duplicate records: fingerprints in pigeonhole blocks, verified by Hamming distance.

A record is the set of its distinct sequences of ``shingle`` words; words are the maximal runs of
a-z and 0-9 in the lower-cased text. Its fingerprint has ``blocks * rows`` symbols, each the least
value of one hash function over the set, so two records differ in a symbol with a chance of one
minus their similarity. The fingerprint is split into ``blocks`` blocks of ``rows`` symbols. By the
pigeonhole principle two fingerprints that differ in fewer symbols than there are blocks have a
block in common; and with the default of 48 blocks of 5 a pair of similarity 0.7 has one with a
chance of 0.9998, one of 0.8 with 1 - 1e-8. Records are joined on blocks, pairs verified by the Hamming distance of the
fingerprints (with a margin of five standard deviations), and those left by the exact similarity of
the sets.

Records of equal sets form one class and only its smallest id is compared, so copies, even if they
are a third of all rows, make no candidate pairs. Results come as pairs of class representatives
plus membership (``classes``, ``links``), as one row per record with its group (``groups``), or as
all pairs of records (``pairs``).

Groups are the connected components of all links, but don't need all of them. First each member of
a block is compared with the block's smallest only, one pair a member. Then only pairs of a block that
lie in different components are, as others can't join anything. So a family of near copies, even if
it is a third of all rows, makes as many pairs as it has members.

Texts are read again only to verify: the sets of those records that a near pair names are made once a
record, and pairs carry sets. No side of these joins is broadcast, as none has a bound.

Null texts and those of fewer than ``shingle`` words form no set and are in no pair; in ``groups``
each is a group of its own. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm.hashing import U, blocks_of, code_points, mix, prefix_hash, span_hash
from lexspan.runtime import drop_table_files, materialize, spread

#: Characters handled at once.
CHUNK = 1 << 18


def _shingles(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all sequences of n words in the texts, and the number of sequences of each text."""
    lowered = [t.lower() for t in texts]
    cp = code_points("\n".join(lowered) + "\n")
    word = ((cp >= 97) & (cp <= 122)) | ((cp >= 48) & (cp <= 57))
    edge = np.flatnonzero(np.diff(word.astype(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    h = span_hash(prefix_hash(cp), start, end)
    ends = np.cumsum([len(t) + 1 for t in lowered])
    of = np.searchsorted(ends, start, side="right")
    words = np.bincount(of, minlength=len(texts))
    counts = np.maximum(words - (n - 1), 0)
    if len(h) < n:
        return np.empty(0, U), counts
    seq = np.zeros(len(h) - n + 1, U)
    for k in range(n):
        seq = mix(seq * U(3) + h[k : k + len(seq)])
    return seq[of[: len(seq)] == of[n - 1 :]], counts


def _fingerprints(shingle: int, blocks: int, rows: int):
    seeds = mix(np.arange(2 * blocks * rows, dtype=U) + U(77))
    mul, add = seeds[: blocks * rows] | U(1), seeds[blocks * rows :]
    schema = pa.schema([("rec", pa.int64()), ("set_id", pa.int64()), ("set_check", pa.int64()), ("n_set", pa.int32()), ("print", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks_of(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), lambda p: len(p[1]), CHUNK):
                seq, counts = _shingles([t for _, t in block], shingle)
                keep = np.flatnonzero(counts)
                if not len(keep):
                    continue
                size = counts[keep]
                of = np.repeat(np.arange(len(keep), dtype=np.int64), size)
                order = np.lexsort((seq, of))
                seq, of = seq[order], of[order]
                first = np.ones(len(seq), bool)
                first[1:] = (seq[1:] != seq[:-1]) | (of[1:] != of[:-1])
                seq, of = seq[first], of[first]
                size = np.bincount(of, minlength=len(keep))
                at = np.concatenate([[0], np.cumsum(size)[:-1]])
                least = np.empty((len(keep), len(mul)), U)
                for j in range(len(mul)):
                    least[:, j] = np.minimum.reduceat(seq * mul[j] + add[j], at)
                mixed = mix(least)
                key = np.tile(np.arange(blocks, dtype=U), (len(keep), 1))
                for k in range(rows):
                    key = mix(key * U(3) + mixed.reshape(len(keep), blocks, rows)[:, :, k])
                prints = (mixed & U(0xFF)).astype(np.uint8)
                ids = [np.add.reduceat(mix(seq + U(s)), at).view(np.int64) for s in (11, 23)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.array([block[i][0] for i in keep], np.int64)),
                        pa.array(ids[0]),
                        pa.array(ids[1]),
                        pa.array(size.astype(np.int32)),
                        pa.array([p.tobytes() for p in prints], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * blocks), pa.array(key.view(np.int64).ravel())),
                    ],
                    schema=schema,
                )

    return run


class NearDuplicates:
    """Finds all pairs of records of at least ``threshold``; see the module's text for the method."""

    def __init__(self, records: DataFrame, rec: str, text: str, threshold: float = 0.8, shingle: int = 5, blocks: int = 48, rows: int = 5):
        self.threshold, self.shingle, self.symbols = threshold, shingle, blocks * rows
        self.texts = records.select(F.col(rec).cast("long").alias("rec"), F.col(text).alias("text")).where("rec IS NOT NULL")
        prints = (
            spread(self.texts.where(F.length("text") > 0))
            .mapInArrow(_fingerprints(shingle, blocks, rows), "rec long, set_id long, set_check long, n_set int, print binary, keys array<long>")
        )
        self.prints = materialize(prints, "prints")
        #: (rec, cls): the class of equal sets of each record, named by its smallest rec.
        rep = self.prints.groupBy("set_id", "set_check").agg(F.min("rec").alias("cls"))
        self.classes = materialize(self.prints.select("rec", "set_id", "set_check").join(rep, ["set_id", "set_check"]).select("rec", "cls").distinct(), "classes")
        self._links: DataFrame | None = None

    def _blocks(self) -> DataFrame:
        """(rec, key): the blocks of the smallest record of each class."""
        reps = self.classes.where("rec = cls").select(F.col("cls").alias("rec"))
        return self.prints.join(reps, "rec", "left_semi").select("rec", F.explode("keys").alias("key"))

    def _verified(self, met: DataFrame) -> DataFrame:
        """(cls_a, cls_b, similarity) of those of the distinct pairs (a, b) that reach the threshold."""
        # Five standard deviations of the number of equal symbols at the threshold; chance matches only add.
        p = self.threshold
        least = int(self.symbols * p - 5 * (self.symbols * p * (1 - p)) ** 0.5)
        marks = self.prints.select("rec", "print", "n_set").distinct().hint("merge")
        both = met.join(marks.select(F.col("rec").alias("a"), F.col("print").alias("pa"), F.col("n_set").alias("na")), "a").join(
            marks.select(F.col("rec").alias("b"), F.col("print").alias("pb"), F.col("n_set").alias("nb")), "b"
        )
        # A set can't reach the threshold with one of less than its share of the size.
        both = both.where(F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(p) - 1e-9)
        near = materialize(both.mapInArrow(_hamming(least), "a long, b long"), "near")
        stored = materialize(self.sets_of(near), "sets")
        sets = stored.hint("merge")
        full = near.join(sets.select(F.col("rec").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("rec").alias("b"), F.col("set").alias("sb")), "b")
        links = materialize(full.mapInArrow(_jaccard(p), "cls_a long, cls_b long, similarity double").distinct(), "links")
        for done in (near, stored):
            drop_table_files(done)
        return links

    def sets_of(self, near: DataFrame) -> DataFrame:
        """(rec, set) of each record that a pair (a, b) names."""
        named = near.select(F.col("a").alias("rec")).union(near.select(F.col("b").alias("rec"))).distinct()
        return self.texts.hint("merge").join(named, "rec").mapInArrow(_sets(self.shingle), "rec long, set binary")

    def links(self) -> DataFrame:
        """(cls_a, cls_b, similarity) of all pairs of different classes of at least the threshold."""
        if self._links is None:
            blocks = self._blocks()
            a, b = blocks.select("key", F.col("rec").alias("a")), blocks.select("key", F.col("rec").alias("b"))
            self._links = self._verified(a.join(b, "key").where("a < b").select("a", "b").distinct())
        return self._links

    def star(self) -> DataFrame:
        """(a, b): each member of a block with the smallest of the block."""
        blocks = self._blocks()
        first = blocks.groupBy("key").agg(F.min("rec").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a")
        return blocks.join(first, "key").where("rec <> a").select("a", F.col("rec").alias("b")).distinct()

    def across(self, roots: DataFrame, done: DataFrame) -> DataFrame:
        """(a, b): pairs of a block with different roots (node, root), without those that are done."""
        blocks = self._blocks().join(roots.select(F.col("node").alias("rec"), "root"), "rec", "left").withColumn("root", F.coalesce("root", "rec"))
        mixed = blocks.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
        rest = blocks.join(mixed, "key", "left_semi")
        a, b = (rest.select("key", F.col("rec").alias(n), F.col("root").alias(f"r{n}")) for n in "ab")
        return a.join(b, "key").where("a < b AND ra <> rb").select("a", "b").distinct().join(done, ["a", "b"], "left_anti")

    def pairs(self) -> DataFrame:
        """(a, b) with a < b: every pair of records of at least the threshold, copies included."""
        m = self.classes
        of_a, of_b = m.select(F.col("rec").alias("ra"), F.col("cls").alias("cls_a")), m.select(F.col("rec").alias("rb"), F.col("cls").alias("cls_b"))
        across = self.links().select("cls_a", "cls_b").join(of_a, "cls_a").join(of_b, "cls_b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        within = of_a.join(of_b.withColumnRenamed("cls_b", "cls_a"), "cls_a").where("ra < rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        return across.union(within)

    def groups(self) -> DataFrame:
        """(rec, class_id, group_id), one row per record: its class of equal sets, and its group, named by the smallest class in it.

        A record without a set is its own class and group.
        """
        ends = lambda links: links.select(F.col("cls_a").alias("u"), F.col("cls_b").alias("v"))
        star = materialize(self.star(), "star")
        near = ends(self._verified(star))
        roots = components(near)
        group = components(near.union(ends(self._verified(self.across(roots, star)))))
        drop_table_files(star)
        ids = self.texts.select("rec").distinct().join(self.classes, "rec", "left").withColumn("cls", F.coalesce("cls", "rec"))
        return ids.join(group.select(F.col("node").alias("cls"), "root"), "cls", "left").select("rec", F.col("cls").alias("class_id"), F.coalesce("root", "cls").alias("group_id"))


def _hamming(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            prints = [np.frombuffer(b"".join(batch.column(names.index(c)).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("pa", "pb")]
            keep = pa.array((prints[0] == prints[1]).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(names.index(c)).filter(keep) for c in ("a", "b")], names=["a", "b"])

    return run


def _sets(shingle: int):
    """The distinct sequences of each text, as sorted hashes of 64 bits."""
    schema = pa.schema([("rec", pa.int64()), ("set", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            sets = [np.unique(_shingles([t], shingle)[0]).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("rec")), pa.array(sets, pa.binary())], schema=schema)

    return run


def _jaccard(threshold: float):
    schema = pa.schema([("cls_a", pa.int64()), ("cls_b", pa.int64()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, x, y in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("a", "b", "sa", "sb"))):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both and both >= threshold * (len(x) + len(y) - both) - 1e-9:
                    out.append((a, b, both / (len(x) + len(y) - both)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [[]] * 3, schema)], schema=schema)

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the connected components of edges (u, v); root is the smallest node.

    Alternates large-star and small-star steps, each a shuffle of the edges, written to the shared
    folder. Ends when a round changes nothing, after a number of rounds that grows with the logarithm
    of the longest path. A node's neighbours are never gathered in one place.
    """
    cur = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    # The number of distinct edges and two sums of hashes of them tell whether a round changed any, without a shuffle.
    digest = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first()
    seen = digest(cur)
    while True:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        nxt = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = digest(nxt)
        drop_table_files(cur)
        cur, same, seen = nxt, now == seen, now
        if same:
            break
    roots = cur.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
