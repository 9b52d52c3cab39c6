"""Exact removal of repeated word sequences, found by recompression.

Every text is a sequence of words. In rounds, runs of one symbol and then pairs of symbols get a
new name: a random but fixed bit of its name makes a symbol a left or a right one, and each left
one followed by a right one becomes a pair. A name is a fingerprint of the names it replaces, so
all Spark tasks give equal runs and pairs equal names without exchanging a dictionary, and equal
substrings have equal symbols inside, apart from their edges. Each symbol carries the range of
words that decided on it; a symbol whose range lies within a window therefore stands in every
copy of that window. The longest such symbol (the least by hash, of several) anchors the window.

Rows of anchors then meet in Spark by name (`repeats`): symbols that occur once end the search,
equal surroundings of a shared symbol cover whole runs of windows, and the edges are verified
window by window with 128-bit fingerprints of the words.

Words are runs of other bytes than white space (space, tab to carriage return), unchanged. A null
text has no words. Documents are ordered by doc_id; see repeats.with_order for null and repeated
ids. Texts shorter than a window lose nothing. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trackmill.llm import repeats
from trackmill.llm.arrays import Sums, byte_values, mix, signed, table_bytes, text_blocks, words_of
from trackmill.llm.scratch import Scratch

WINDOW = 20
ROUNDS = 4
LONG = 7

WORD = ~table_bytes(bytes([0x20, *range(0x09, 0x0E)]))
_SIDES = np.random.default_rng(11).integers(1, 2**63, size=64, dtype=np.uint64)


def word_values(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Two independent fingerprints of every word, and where the texts' words begin."""
    starts, ends, counts = words_of(data, offsets, WORD)
    return [Sums(byte_values(data, seed), seed).of(starts, ends) for seed in (0, 1)], counts


class Symbols:
    """Symbols in text order: name, words start..stop-1, and the words lo..hi-1 that decided on them."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        n = len(words)
        self.counts = counts
        self.name, self.start, self.stop = words, np.arange(n), np.arange(1, n + 1)
        self.lo, self.hi = self.start.copy(), self.stop.copy()
        self.text = np.repeat(np.arange(len(counts) - 1), np.diff(counts))

    def _neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """What is known of the symbols before and after each: their ranges, or beyond the text's edge."""
        before, after = self.counts[self.text] - 1, self.counts[self.text + 1] + 1
        same = self.text[1:] == self.text[:-1]
        before[1:] = np.where(same, self.lo[:-1], before[1:])
        after[:-1] = np.where(same, self.hi[1:], after[:-1])
        return before, after

    def _keep(self, heads: np.ndarray, tails: np.ndarray) -> None:
        self.start, self.stop, self.text = self.start[heads], self.stop[tails], self.text[heads]

    def name_runs(self) -> None:
        n = len(self.name)
        new = np.ones(n, dtype=bool)
        new[1:] = (self.name[1:] != self.name[:-1]) | (self.text[1:] != self.text[:-1])
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], n) - 1
        before, after = self._neighbours()
        size = (tails - heads + 1).astype(np.uint64)
        self.name = np.where(size > 1, mix(self.name[heads] + size * np.uint64(0xA24BAED4963EE407)), self.name[heads])
        self.lo, self.hi = np.minimum(self.lo[heads], before[heads]), np.maximum(self.hi[tails], after[tails])
        self._keep(heads, tails)

    def name_pairs(self, seed: np.uint64) -> None:
        right = (mix(self.name ^ seed) & np.uint64(1)).astype(bool)
        pair = np.zeros(len(self.name), dtype=bool)
        pair[:-1] = ~right[:-1] & right[1:] & (self.text[1:] == self.text[:-1])
        second = np.zeros(len(self.name), dtype=bool)
        second[1:] = pair[:-1]
        before, after = self._neighbours()
        lone = ~pair & ~second
        self.lo = np.where(lone & right, np.minimum(self.lo, before), self.lo)
        self.hi = np.where(lone & ~right, np.maximum(self.hi, after), self.hi)
        heads = np.flatnonzero(~second)
        tails = heads + pair[heads]
        self.name = np.where(pair[heads], mix(self.name[heads] * np.uint64(0x9FB21C651E98DF25) + self.name[tails]), self.name[heads])
        self.lo, self.hi = np.minimum(self.lo[heads], self.lo[tails]), np.maximum(self.hi[heads], self.hi[tails])
        self._keep(heads, tails)


def anchors(words: list[np.ndarray], counts: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Text, k, u, lo and n of the rows of all texts' windows."""
    counts = counts.astype(np.int64)
    n_windows = np.maximum(np.diff(counts) - window + 1, 0)
    text = np.repeat(np.arange(len(n_windows)), n_windows)
    if not len(text):
        return (np.zeros(0, np.int64),) * 5
    ends = np.cumsum(n_windows)
    lo = np.arange(ends[-1]) - np.repeat(ends - n_windows, n_windows)
    at = lo + counts[:-1][text]
    s = Symbols(words[0], counts)
    s.name_runs()
    for r in range(ROUNDS):
        s.name_pairs(_SIDES[r])
    low = np.minimum.accumulate(s.lo[::-1])[::-1]  # wider ranges in text order, still sound
    high = np.maximum.accumulate(s.hi)
    first, last = np.searchsorted(low, at, "left"), np.searchsorted(high, at + window, "right")
    rank = (np.uint64(LONG) - np.minimum(s.stop - s.start, LONG).astype(np.uint64) << np.uint64(61)) | (mix(s.name) >> np.uint64(3))
    least = repeats.Least(rank, window)
    owner = np.full(len(at), -1, dtype=np.int64)
    some = np.flatnonzero(first < last)
    owner[some] = least.of(first[some], last[some])
    bare = np.flatnonzero(owner < 0)  # no symbol fits: such a window is its own anchor
    owner[bare] = -1 - bare
    heads, size = repeats.runs(owner, text)
    begin = at[heads]
    sums = Sums(words[1], 1)
    u = sums.of(begin, begin + size + window - 1)
    own = owner[heads]
    k = np.where(own >= 0, s.name[np.maximum(own, 0)], Sums(words[0]).of(begin, begin + window))
    return text[heads], k, u, lo[heads], size


def _rows(window: int):
    def run(batches):
        for batch in batches:
            rid = batch.column("rid").to_numpy()
            for a, b, data, offsets in text_blocks(batch, "text"):
                text, k, u, lo, n = anchors(*word_values(data, offsets), window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid[a:b][text]), pa.array(signed(k)), pa.array(signed(u)), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["rid", "k", "u", "lo", "n"],
                )

    return run


def _measure(window: int):
    def run(data: np.ndarray, lo: np.ndarray, n: np.ndarray):
        starts, ends, _ = words_of(data, np.array([0, len(data)]), WORD)
        gone = repeats.covered(lo, n, window, len(starts)) if len(lo) else np.zeros(len(starts), dtype=bool)
        text = data.tobytes()
        kept = b" ".join([text[a:b] for a, b in zip(starts[~gone].tolist(), ends[~gone].tolist(), strict=True)])
        return len(starts), int(gone.sum()), repeats.sha256(kept)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and the SHA-256 of the kept words.

    A word goes if a window of `window` words over it also starts earlier: in a document with a
    smaller doc_id, or before in the same document.
    """
    scratch = Scratch(docs.sparkSession)
    docs = repeats.with_order(docs, scratch)
    rows = scratch.save("rows", docs.select("rid", "text").mapInArrow(_rows(window), repeats.ROW))
    shared = scratch.save("shared", rows.groupBy("k").agg(F.count("*").alias("c")).filter("c > 1").select("k"))
    some = scratch.save("some", rows.join(shared, "k"))
    scratch.drop("rows", "shared")
    found = repeats.resolve(some, docs, word_values, window, True, scratch)
    return repeats.report(docs, found, _measure(window), "n_words long, n_removed long, kept_sha256 string")
