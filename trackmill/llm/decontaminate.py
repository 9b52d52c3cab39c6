"""Benchmark decontamination by pigeonhole edit matching.

A test item of n words may occur in a text with up to e = ERROR_SHARE * n word edits
(insertions, deletions, replacements). Cut into e + 1 pieces of consecutive words, at least one
piece then occurs unchanged; every exact hit of a piece is verified by the bit-parallel edit
distance of the whole item to the text around the hit. Words are runs of letters and digits
(A-Z in lower case, every non-ASCII character counts as a letter), so layout and punctuation
do not matter.

Items with fewer than MIN_WORDS words or null text identify no source and match nothing;
repeated items all match. The items are read in blocks of at most BLOCK_WORDS words, so what a
task holds of them is bounded, whatever the benchmark's size. A null or empty text matches
nothing. Rows with equal doc_id are judged one by one.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from trackmill.llm.arrays import Sums, byte_values, table_bytes, text_blocks, words_of
from trackmill.llm.scratch import free_name

ERROR_SHARE = 0.2
MIN_WORDS = 5
BLOCK_WORDS = 2_000_000

WORD = table_bytes(bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_prints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words of all texts, and how many words precede each text."""
    starts, ends, counts = words_of(data, offsets, WORD)
    return Sums(byte_values(LOWER[data])).of(starts, ends), counts


def allowed_edits(n_words: int, share: float) -> int:
    return int(n_words * share)


def pieces(n_words: int, edits: int) -> list[tuple[int, int]]:
    """Starts and ends of edits + 1 nearly equal parts."""
    cuts = [n_words * k // (edits + 1) for k in range(edits + 2)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def least_edits(item: list[int], text: list[int]) -> int:
    """The least edit distance of the item to any part of the text, word by word (Myers 1999)."""
    n = len(item)
    at: dict[int, int] = defaultdict(int)
    for i, word in enumerate(item):
        at[word] |= 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, distance, best = full, 0, n, n
    for word in text:
        same = at.get(word, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right, left = down | ~(diagonal | up) & full, up & diagonal
        if right & top:
            distance += 1
        elif left & top:
            distance -= 1
        # a match may begin anywhere in the text, so the first row costs nothing
        right, left = (right << 1) & full, (left << 1) & full
        up, down = left | ~(diagonal | right) & full, right & diagonal
        best = min(best, distance)
    return best


class Items:
    """A block of test items, ready to be looked for."""

    def __init__(self, rows: list[tuple[int, list[int]]], share: float):
        self.share, self.words = share, rows
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for k, (_, words) in enumerate(rows):
            for start, stop in pieces(len(words), allowed_edits(len(words), share)):
                found[stop - start].append((k, start, stop))
        self.by_length = []
        for length, parts in sorted(found.items()):
            prints = np.array([Sums(np.array(rows[k][1], dtype=np.uint64)).of(np.array([a]), np.array([b]))[0] for k, a, b in parts], dtype=np.uint64)
            order = np.argsort(prints, kind="stable")
            table = np.zeros(1 << 16, dtype=bool)
            table[prints >> np.uint64(48)] = True
            self.by_length.append((length, prints[order], [parts[i] for i in order], table))

    def hits(self, words: np.ndarray, counts: np.ndarray) -> dict[int, set[int]]:
        """Per text, the places in self.words of the items it contains."""
        sums = Sums(words)
        near: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for length, prints, parts, table in self.by_length:
            if len(words) < length:
                continue
            starts = np.arange(len(words) - length + 1)
            found = sums.of(starts, starts + length)
            maybe = np.flatnonzero(table[found >> np.uint64(48)])
            first = np.searchsorted(prints, found[maybe], "left")
            last = np.searchsorted(prints, found[maybe], "right")
            hit = last > first
            for i, a, b in zip(maybe[hit].tolist(), first[hit].tolist(), last[hit].tolist(), strict=True):
                text = int(np.searchsorted(counts, i, "right")) - 1
                if i + length <= counts[text + 1]:
                    for k, start, _ in parts[a:b]:
                        near[text, k].append((i - start, start))
        out: dict[int, set[int]] = defaultdict(set)
        for (text, k), begins in near.items():
            item = self.words[k][1]
            edits = allowed_edits(len(item), self.share)
            done = -1
            for begin, _ in sorted(begins):
                if begin <= done:
                    continue
                first, last = max(int(counts[text]), begin - edits), min(int(counts[text + 1]), begin + len(item) + edits)
                if least_edits(item, words[first:last].tolist()) <= edits:
                    out[text].add(k)
                    break
                done = begin
        return out


def _items(benchmark: DataFrame, share: float):
    """The items in blocks of bounded size, read one partition of blocks at a time."""

    def prints(batches):
        for batch in batches:
            ids = batch.column("item_id")
            for first, last, data, offsets in text_blocks(batch, "text"):
                words, counts = word_prints(data, offsets)
                parts = [words[counts[i] : counts[i + 1]].tobytes() for i in range(last - first)]
                yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), pa.array(parts, pa.binary())], names=["item_id", "words"])

    rows, held = [], 0
    for r in benchmark.select("item_id", "text").mapInArrow(prints, "item_id long, words binary").toLocalIterator():
        words = np.frombuffer(r["words"], dtype=np.uint64).tolist()
        if len(words) < MIN_WORDS:
            continue
        if rows and held + len(words) > BLOCK_WORDS:
            yield Items(rows, share)
            rows, held = [], 0
        rows.append((r["item_id"], words))
        held += len(words)
    if rows:
        yield Items(rows, share)


def flag(docs: DataFrame, benchmark: DataFrame, name: str = "item_ids", share: float = ERROR_SHARE) -> DataFrame:
    """docs with the sorted distinct ids of the items found in each text, as an array column."""
    for block in _items(benchmark, share):
        docs = _search(docs, block, name)
    if name not in docs.columns:
        docs = docs.withColumn(name, F.array().cast("array<bigint>"))
    return docs


def _search(docs: DataFrame, block: Items, name: str) -> DataFrame:
    before = name in docs.columns
    columns = [c for c in docs.columns if c != name]
    docs = docs.select(*(F.col(f"`{c}`") for c in columns), *([name] if before else []))
    schema = T.StructType([*docs.schema.fields[: len(columns)], T.StructField(name, T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            found = [set(x) for x in batch.column(name).to_pylist()] if before else [set() for _ in range(batch.num_rows)]
            for first, _, data, offsets in text_blocks(batch, "text"):
                words, counts = word_prints(data, offsets)
                for text, items in block.hits(words, counts).items():
                    found[first + text].update(block.words[k][0] for k in items if block.words[k][0] is not None)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array([sorted(x) for x in found], pa.list_(pa.int64()))], names=[*columns, name])

    return docs.mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, share: float = ERROR_SHARE) -> DataFrame:
    """One row per document: doc_id, contaminated (0 or 1), n_items and item_ids."""
    found = flag(docs.select("doc_id", "text"), benchmark, "item_ids", share)
    return found.select("doc_id", (F.size("item_ids") > 0).cast("int").alias("contaminated"), F.size("item_ids").alias("n_items"), "item_ids")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = ERROR_SHARE) -> DataFrame:
    """docs without those that contain a test item, in the columns of docs."""
    name = free_name(docs, "item_ids")
    return flag(docs, benchmark, name, share).filter(F.size(name) == 0).select(*(F.col(f"`{c}`") for c in docs.columns))
