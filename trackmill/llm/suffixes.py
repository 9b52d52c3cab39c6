"""Removal of bytes that repeat strings of earlier documents, by a logarithmic family of suffix indexes.

Documents come in batches, in the order of their ids. A batch gets a sparse suffix array: of
every window of 50 bytes the suffix whose first PREFIX bytes hash least is an entry, so each
50-byte string has an entry that depends on its own bytes only. Windows in a row with one entry
travel as one entry (k, u, rid, lo, n), as in `repeats`. Entries are ordered by the fingerprint k
of their prefix (equal prefixes are neighbours, which is all the scan needs; unequal ones are not
in letter order). An array is cut into buckets, ranges of k, and a row holds a sorted piece of one
bucket, so Spark deals and shuffles pieces and no single entries. Each new array is merge-scanned
against the levels of the index, bucket by bucket; the batch then becomes a level itself, and two
levels of equal size merge into one of twice the size within that scan, so an entry is rewritten
at most log2(batches) times.

Of entries with equal prefix and surroundings (k, u) all but those of the first document are
covered as soon as two of them meet, before the shuffle already, so copies neither move nor swell
the levels. Where a prefix has several surroundings, one entry of each is opened into its single
windows, which meet in the same way. Both steps compare 128 bits of fingerprints.

A null text is empty. Matches never cross documents, and repeats within a document do not count.
For null and repeated ids see repeats.with_order. An empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trackmill.llm import repeats
from trackmill.llm.arrays import Sums, byte_values, text_blocks
from trackmill.llm.scratch import CLEAN, Scratch, setting

WINDOW = 50
PREFIX = 24
BATCHES = 4
BUCKET_BYTES = 16 << 20
BLOCK = 1 << 18
RANGES = 8
GATHERED = 1 << 18
PIECE = 1 << 16

ENTRY = np.dtype([("k", "<u8"), ("u", "<u8"), ("rid", "<i8"), ("lo", "<i4"), ("n", "<i4")])
PLACE = np.dtype([("rid", "<i8"), ("lo", "<i4"), ("n", "<i4")])
#: What a row of pieces holds.
NEW, COVERED, LEVEL, JOINING, EDGES = range(5)
PIECES = "what int, bucket int, data binary"
SOURCE = 28


def entries(data: np.ndarray, offsets: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, ...]:
    """Text, k, u, lo and n of the rows of all texts' windows."""
    offsets = offsets.astype(np.int64)
    if not len(data) or np.diff(offsets).max() < window:
        return (np.zeros(0, np.int64),) * 5
    sums = Sums(byte_values(data))
    owner = _leftmost_least(sums.ranks(prefix), window - prefix + 1)
    turns = np.flatnonzero(owner[1:] != owner[:-1]) + 1
    begin = np.sort(np.concatenate([turns, offsets[:-1], np.maximum(offsets[1:] - window + 1, offsets[:-1])]))
    begin = begin[(np.diff(begin, append=len(data)) > 0) & (begin < len(owner))]
    size = np.diff(np.append(begin, len(owner)))
    text = np.searchsorted(offsets, begin, "right") - 1
    whole = begin + window <= offsets[text + 1]  # the windows before a text's end cross into the next
    begin, size, text = begin[whole], size[whole], text[whole]
    k = sums.of(owner[begin], owner[begin] + prefix)
    u = Sums(byte_values(data, 1), 1).of(begin, begin + size + window - 1)
    return text, k, u, begin - offsets[text], size


def _leftmost_least(rank: np.ndarray, width: int) -> np.ndarray:
    """For each place, the leftmost place with the least upper half of the `width` ranks from it on."""
    low = np.uint64(0xFFFFFFFF)
    best, span = (rank & ~low) | np.arange(len(rank), dtype=np.uint64), 1
    while span < width:
        step = min(span, width - span)
        best = np.minimum(best[:-step], best[step:])
        span += step
    return (best & low).astype(np.int64)


def _packed(k: np.ndarray, u: np.ndarray, rid: np.ndarray, lo: np.ndarray, n) -> np.ndarray:
    out = np.empty(len(k), dtype=ENTRY)
    out["k"], out["u"], out["rid"], out["lo"], out["n"] = k, u, rid, lo, n
    return out


def _places(rows: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), dtype=PLACE)
    for name in PLACE.names:
        out[name] = rows[name]
    return out


def fold(rows: np.ndarray, sort: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The rows ordered by (k, u, rid, lo), and which of them have an equal (k, u) in an earlier document."""
    order = np.argsort(rows["k"], kind=sort)  # a stable sort merges sorted pieces
    k = rows["k"][order]
    same = k[1:] == k[:-1]
    some = np.zeros(len(k), dtype=bool)
    some[1:] = same
    some[:-1] |= same
    some = np.flatnonzero(some)
    part = order[some]
    met = rows[part]
    order[some] = part[np.lexsort((met["lo"], met["rid"], met["u"], met["k"]))]
    rows = rows[order]
    head = np.ones(len(rows), dtype=bool)
    head[1:] = ~same | (rows["u"][1:] != rows["u"][:-1])
    rid = rows["rid"]
    return rows, rid > rid[np.flatnonzero(head)][np.cumsum(head) - 1]


def _split(what: int, bucket: int, rows: np.ndarray) -> list[tuple[int, int, bytes]]:
    return [(what, bucket, rows[i : i + PIECE].tobytes()) for i in range(0, len(rows), PIECE)]


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    what, bucket, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(what, pa.int32()), pa.array(bucket, pa.int32()), pa.array(data, pa.binary())], names=["what", "bucket", "data"])


def _cut(what: int, rows: np.ndarray, buckets: int) -> list[tuple[int, int, bytes]]:
    """Sorted rows as pieces, one of each bucket that has any."""
    bucket = ((rows["k"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    ends = np.searchsorted(bucket, np.arange(buckets + 1))
    return [(what, i, rows[ends[i] : ends[i + 1]].tobytes()) for i in np.flatnonzero(np.diff(ends)).tolist()]


def _pieces(read: Callable, buckets: int) -> Callable:
    """Rows of PIECES of what read gives of each Arrow batch; rows that are covered by others of the piece go as such."""

    def emit(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows, gone = fold(np.concatenate(held))
        out = _cut(NEW, rows[~gone], buckets)
        yield _rows(out + _split(COVERED, int(rows["k"][0] % np.uint64(buckets)), _places(rows[gone])))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for rows in read(batch):
                if len(rows):
                    held.append(rows)
                    size += len(rows)
                if size >= GATHERED:
                    yield from emit(held)
                    held, size = [], 0
        if held:
            yield from emit(held)

    return run


def _entries(window: int, prefix: int) -> Callable:
    def read(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        rid = batch.column("rid").to_numpy()
        for a, b, data, offsets in text_blocks(batch, "text", BLOCK):
            text, k, u, lo, n = entries(data, offsets, window, prefix)
            yield _packed(k, u, rid[a:b][text], lo, n)

    return read


def _windows(window: int) -> Callable:
    def read(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        rid = batch.column("rid").to_numpy()
        for a, b, data, offsets in text_blocks(batch, "text", BLOCK):
            text, lo, n = repeats.listed(batch.column("places").slice(a, b - a))
            ends = np.cumsum(n)
            at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n - lo, n)
            text = np.repeat(text, n)
            start = at + offsets[text]
            w1, w2 = (Sums(byte_values(data, seed), seed).of(start, start + window) for seed in (0, 1))
            yield _packed(w1, w2, rid[a:b][text], at, 1)

    return read


def _scan(insert: bool, edges: bool) -> Callable:
    """Of the pieces of a bucket: what is covered; with edges, those; with insert, the pieces of the new level."""

    def run(table: pa.Table) -> pa.Table:
        whats, buckets, data = (table.column(x).to_pylist() for x in ("what", "bucket", "data"))
        out = [row for row in zip(whats, buckets, data, strict=True) if row[0] == COVERED]
        pieces = [(what, x) for what, x in zip(whats, data, strict=True) if what != COVERED]
        rows = np.frombuffer(bytearray().join(x for _, x in pieces), dtype=ENTRY)
        source = np.repeat([what for what, _ in pieces], [len(x) // ENTRY.itemsize for _, x in pieces]).astype(np.int32)
        rows["n"] |= source << SOURCE  # what a row is goes with it through the sort
        rows, gone = fold(rows, "stable")
        source = rows["n"] >> SOURCE
        rows["n"] &= (1 << SOURCE) - 1
        out += _split(COVERED, buckets[0], _places(rows[gone]))
        rows, source = rows[~gone], source[~gone]
        head = np.ones(len(rows), dtype=bool)
        head[1:] = rows["k"][1:] != rows["k"][:-1]
        if edges and len(rows):
            first, rid = np.flatnonzero(head), rows["rid"]
            several = (np.minimum.reduceat(rid, first) < np.maximum.reduceat(rid, first)) & np.logical_or.reduceat(source == NEW, first)
            out += _split(EDGES, buckets[0], _places(rows[several[np.cumsum(head) - 1]]))
        if insert:
            head[1:] |= rows["u"][1:] != rows["u"][:-1]
            out += _split(LEVEL, buckets[0], rows[head & (source != LEVEL)])
        return pa.Table.from_batches([_rows(out)])

    return run


def _unpacked(batches):
    for batch in batches:
        rows = np.frombuffer(b"".join(batch.column("data").to_pylist()), dtype=PLACE)
        yield pa.RecordBatch.from_arrays([pa.array(rows[x]) for x in PLACE.names], names=list(PLACE.names))


class Index:
    """Levels of sorted entries, in bucketed tables of pieces, and what their scans have found."""

    def __init__(self, scratch: Scratch, parts: int):
        self.scratch, self.parts, self.spark = scratch, parts, scratch.spark  # RANGES buckets a part, so that parts are about equal
        self.name = f"suffixes_{uuid.uuid4().hex}"
        self.levels: list[tuple[int, str]] = []  # batches merged, table
        self.tables: list[str] = []

    def scan(self, rows: DataFrame, read: Callable, joining: int = 0, insert: bool = False, edges: bool = False) -> str:
        """Merge-scan new rows, as read gives them, with all levels; the table of what was found.

        With insert, the new rows become a level in it, merged with the last `joining` levels.
        """
        table = f"{self.name}_{len(self.tables)}"
        met = rows.mapInArrow(_pieces(read, RANGES * self.parts), PIECES).repartition(self.parts, "bucket")
        for i, (_, level) in enumerate(reversed(self.levels)):  # a level lies in the same buckets: it is not dealt again
            old = self.spark.table(level).filter(F.col("what") == LEVEL)
            met = met.union(old.select(F.lit(JOINING if i < joining else LEVEL).alias("what"), "bucket", "data"))
        out = met.groupBy("bucket").applyInArrow(_scan(insert, edges), PIECES)
        self.tables.append(table)
        with setting(self.spark, CLEAN, "true"):
            out.write.format("parquet").option("compression", "zstd").option("path", f"{self.scratch.root}/{table}").partitionBy("what").bucketBy(self.parts, "bucket").saveAsTable(table)
        return table

    def add(self, rows: DataFrame, read: Callable, last: bool = False) -> None:
        """Add a batch of later documents than all before."""
        joining = 0
        while not last and joining < len(self.levels) and self.levels[-1 - joining][0] == 1 << joining:
            joining += 1
        table = self.scan(rows, read, joining, insert=not last, edges=True)
        for _ in range(joining):
            self._drop(self.levels.pop()[1])
        if not last:
            self.levels.append((1 << joining, table))

    def _drop(self, table: str) -> None:
        self.scratch.drop(f"{table}/what={LEVEL}")

    def found(self, what: int = COVERED) -> DataFrame:
        """(rid, lo, n) of all scans so far."""
        parts = [self.spark.read.schema(PIECES).parquet(f"{self.scratch.root}/{table}").filter(F.col("what") == what).select("data") for table in self.tables]
        return reduce(DataFrame.union, parts).mapInArrow(_unpacked, "rid long, lo int, n int")

    def close(self) -> None:
        """Drop the levels; what was found stays."""
        for _, table in self.levels:
            self._drop(table)
        self.levels = []
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")


def remove_earlier(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, batches: int = BATCHES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the kept bytes.

    A byte goes if a string of `window` bytes over it also starts in a document with a smaller doc_id.
    """
    scratch = Scratch(docs.sparkSession)
    docs = repeats.with_order(docs, scratch)
    seen = docs.agg(F.percentile_approx("rid", [i / batches for i in range(1, batches)], 10_000).alias("cuts"), F.sum(F.octet_length("text")).alias("size")).first()
    cuts = [None, *sorted(set(seen["cuts"] or [])), None]
    index = Index(scratch, max(8, -(-(seen["size"] or 0) // BUCKET_BYTES)))
    try:
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            part = docs if a is None else docs.filter(F.col("rid") > a)
            part = part if b is None else part.filter(F.col("rid") <= b)
            index.add(part.select("rid", "text"), _entries(window, prefix), last=i == len(cuts) - 2)
        index.close()  # single windows meet each other only
        places = index.found(EDGES).groupBy("rid").agg(F.collect_set(F.struct("lo", "n")).alias("places"))
        index.scan(docs.select("rid", "text").join(places, "rid"), _windows(window))
    finally:
        index.close()

    def measure(data: np.ndarray, lo: np.ndarray, n: np.ndarray):
        gone = repeats.covered(lo, n, window, len(data)) if len(lo) else np.zeros(len(data), dtype=bool)
        spans = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[0]) if len(gone) else 0
        return len(data), int(gone.sum()), spans, repeats.sha256(data[~gone].tobytes())

    return repeats.report(docs, index.found(), measure, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
