"""What the two exact substring operators share: anchored windows and their resolution.

A window is a string of fixed length. An operator gives every window an anchor, chosen from the
window's own content only, so equal windows have equal anchors at equal offsets. Windows in a row
with one anchor travel as one row (rid, k, u, lo, n): k names the anchor, u fingerprints all that
the n windows from lo on cover, and rid orders documents. Then

* a row whose (k, u) has an earlier row is covered in full;
* a row whose k occurs with no other u has no further repeats;
* only the rest, edges of long matches, is compared window by window, by two 64-bit fingerprints.

All three are aggregations and joins on fingerprints, so a hot key is added up before it moves
and no group is gathered in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackmill.llm.arrays import Sums, text_blocks
from trackmill.llm.scratch import Scratch

ROW = "rid long, k long, u long, lo int, n int"


def with_order(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """rid, doc_id, text: rid is doc_id if that is unique and never null, else the rank by (doc_id, text).

    Null ids come last then, and rows of equal doc_id are documents of their own, in the order of their texts.
    """
    rows = docs.select("doc_id", "text")
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1 OR doc_id IS NULL")
    if odd.isEmpty():
        return rows.select(F.col("doc_id").cast("long").alias("rid"), "doc_id", "text")
    order = [F.asc_nulls_last("doc_id"), F.asc_nulls_first("text")]
    ranged = rows.repartitionByRange(*order).select("*", F.spark_partition_id().cast("long").alias("part"))
    placed = ranged.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    return scratch.save("ordered", placed.select((F.col("part") * F.lit(1 << 40) + F.col("at")).alias("rid"), "doc_id", "text"))


def runs(owner: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Firsts and lengths of the runs of equal (owner, text)."""
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(owner)))


class Least:
    """Leftmost least of any range of at most 2^levels - 1 ranks, from a sparse table."""

    def __init__(self, rank: np.ndarray, longest: int):
        self.rank, self.tables, step = rank, [np.arange(len(rank))], 1
        while 2 * step <= longest and 2 * step <= len(rank):
            left, right = self.tables[-1][:-step], self.tables[-1][step:]
            self.tables.append(np.where(rank[left] <= rank[right], left, right))
            step *= 2

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """For ranges first..last-1, none of them empty."""
        out = np.empty(len(first), dtype=np.int64)
        level = np.frexp((last - first).astype(float))[1] - 1
        for at, table in enumerate(self.tables):
            some = np.flatnonzero(level == at)
            left, right = table[first[some]], table[last[some] - (1 << at)]
            out[some] = np.where(self.rank[left] <= self.rank[right], left, right)
        return out


def resolve(rows: DataFrame, docs: DataFrame, units: Callable, length: int, within: bool, scratch: Scratch, slices: int = 1) -> DataFrame:
    """Covered windows as (rid, lo, n), from the rows whose k occurs more than once.

    units gives of a block of texts the values of its units for either fingerprint and where the
    texts' units begin; within: whether an earlier window of the same document counts.
    The edges are opened in `slices` parts of all anchors, one after the other, to bound the disk in use.
    """
    first = F.min(F.struct("rid", "lo")).alias("first")
    contexts = rows.groupBy("k", "u").agg(first, F.max("n").alias("n"))
    contexts = scratch.save("contexts", contexts.select("k", "u", F.col("first.rid").alias("rid"), F.col("first.lo").alias("lo"), "n"))
    earlier = contexts.select("k", "u", F.col("rid").alias("r1"), F.col("lo").alias("l1"))
    later = (F.col("rid") > F.col("r1")) | ((F.col("rid") == F.col("r1")) & (F.col("lo") > F.col("l1")) if within else F.lit(False))
    known = scratch.save("covered", rows.join(earlier, ["k", "u"]).filter(later).select("rid", "lo", "n"))
    # edges: several contexts around one anchor, the first row of each stands for all
    several = contexts.groupBy("k").agg(F.count("*").alias("c")).filter("c > 1").select("k")
    edges = contexts.join(several, "k").select("k", "rid", "lo", "n")
    if not within:  # without a match inside documents, later rows of the first document need a look too
        again = rows.join(contexts.select("k", "u", "rid", F.col("lo").alias("l1")), ["k", "u", "rid"]).filter(F.col("lo") > F.col("l1"))
        edges = edges.union(again.join(several, "k").select("k", "rid", "lo", "n"))

    def windows(batches):
        for batch in batches:
            rid = batch.column("rid").to_numpy()
            lists = batch.column("places")
            for a, b, data, offsets in text_blocks(batch, "text"):
                values, begins = units(data, offsets)
                sums = [Sums(v, seed) for seed, v in enumerate(values)]
                part = lists.slice(a, b - a)
                flat = part.flatten()
                sizes = np.diff(np.asarray(part.offsets))
                lo, n = (flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("lo", "n"))
                text = np.repeat(np.repeat(np.arange(b - a), sizes), n)
                ends = np.cumsum(n)
                at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(lo, n)
                start = at + begins[text]
                found = [s.of(start, start + length).view(np.int64) for s in sums]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[0]), pa.array(found[1]), pa.array(rid[a:b][text]), pa.array(at.astype(np.int32))], names=["w1", "w2", "rid", "lo"]
                )

    for i in range(slices):  # equal windows have equal anchors, so a slice of anchors stands alone
        places = edges.filter(F.pmod("k", F.lit(slices)) == i).groupBy("rid").agg(F.collect_list(F.struct("lo", "n")).alias("places"))
        wanted = docs.select("rid", "text").join(places, "rid")
        opened = scratch.save(f"windows-{i}", wanted.mapInArrow(windows, "w1 long, w2 long, rid long, lo int"))
        firsts = opened.groupBy("w1", "w2").agg(first, F.count("*").alias("c")).filter("c > 1").select("w1", "w2", F.col("first.rid").alias("r1"), F.col("first.lo").alias("l1"))
        single = scratch.save(f"single-{i}", opened.join(firsts, ["w1", "w2"]).filter(later).select("rid", "lo", F.lit(1).alias("n")).distinct())
        known = known.union(single)
        scratch.drop(f"windows-{i}")
    scratch.drop("contexts")
    return known


def covered(lo: np.ndarray, n: np.ndarray, length: int, units: int) -> np.ndarray:
    """Which of a document's units the windows lo .. lo+n-1 cover."""
    edge = np.zeros(units + 1, dtype=np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, np.minimum(lo + n + length - 1, units), -1)
    return np.cumsum(edge[:-1]) > 0


def listed(places: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, lo and n of all entries of the texts' lists of places."""
    sizes = pc.fill_null(pc.list_value_length(places), 0).to_numpy(zero_copy_only=False)
    flat = places.flatten()
    lo, n = (flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("lo", "n"))
    return np.repeat(np.arange(len(places)), sizes), lo, n


def report(docs: DataFrame, found: DataFrame, measure: Callable, schema: str) -> DataFrame:
    """measure(text bytes, lo, n) of every document of docs, with doc_id before it."""
    lists = found.groupBy("rid").agg(F.collect_list(F.struct("lo", "n")).alias("places"))
    names = ["doc_id", *(c.split()[0] for c in schema.split(", "))]

    def run(batches):
        for batch in batches:
            ids, out = batch.column("doc_id"), []
            for a, b, data, offsets in text_blocks(batch, "text"):
                text, lo, n = listed(batch.column("places").slice(a, b - a))
                ends = np.searchsorted(text, np.arange(b - a + 1))
                for i in range(b - a):
                    own = slice(ends[i], ends[i + 1])
                    out.append(measure(data[offsets[i] : offsets[i + 1]], lo[own], n[own]))
            columns = [pa.array(list(c)) for c in zip(*out, strict=True)]
            if columns:
                yield pa.RecordBatch.from_arrays([ids, *columns], names=names)

    return docs.join(lists, "rid", "left").select("doc_id", "text", "places").mapInArrow(run, f"doc_id long, {schema}")


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
