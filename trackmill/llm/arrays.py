"""Arrow batches as flat NumPy arrays: bytes, words and their fingerprints.

Fingerprints are 64-bit sums of powers over random byte codes, finished by a bit mixer.
The fingerprint of any substring then follows from two prefix sums, so one pass over a
block of texts serves every window in it. Equal strings have equal fingerprints in every
task, as codes and powers are fixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

_CODES = np.random.default_rng(20240607).integers(1, 2**63, size=(2, 256), dtype=np.uint64) | np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def powers(n: int, seed: int = 0, inverse: bool = False) -> np.ndarray:
    """The first n powers of the base (or of its inverse) modulo 2^64."""
    have = _POWERS.get((seed, inverse))
    if have is None or len(have) < n:
        base = pow(_BASES[seed], -1, 2**64) if inverse else _BASES[seed]
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        have = _POWERS[(seed, inverse)] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Sums:
    """Prefix sums of a sequence of 64-bit values, for fingerprints of its ranges."""

    def __init__(self, values: np.ndarray, seed: int = 0):
        self.seed = seed
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * powers(len(values), seed), out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Fingerprints of the ranges; the length takes part, so ranges of zeros differ."""
        inverse = powers(len(self.sums), self.seed, True)
        return mix((self.sums[stop] - self.sums[start]) * inverse[start] + (stop - start).astype(np.uint64))

    def ranks(self, size: int) -> np.ndarray:
        """A value of each range of `size`, equal for equal ranges and random in its upper bits."""
        return (self.sums[size:] - self.sums[:-size]) * powers(len(self.sums) - size, self.seed, True)


def byte_values(data: np.ndarray, seed: int = 0) -> np.ndarray:
    return _CODES[seed][data]


def text_blocks(batch: pa.RecordBatch, column: str, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows first..last-1, their UTF-8 bytes joined, and where each row's bytes start (one more than rows).

    A null text counts as an empty one. A block holds about `most` bytes, or one longer text.
    """
    texts = pc.fill_null(batch.column(column).cast(pa.large_string()), "").cast(pa.large_binary())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        last = min(last, n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words_of(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and how many words precede each text (one more than texts).

    is_word says for each byte value whether it belongs to words; words never cross texts.
    """
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = is_word[data]
    starts = np.flatnonzero(inside[1:-1] & ~inside[:-2])
    cuts = np.unique(offsets[1:-1])
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = cuts[inside[cuts] & inside[cuts + 1]]  # a word runs up to the next text's first byte
    if len(cuts):
        starts = np.sort(np.concatenate([starts, cuts]))
    ends = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    if len(cuts):
        ends = np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(starts, offsets)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def table_bytes(chars: bytes) -> np.ndarray:
    """A truth table over byte values: true for those in chars."""
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(chars, dtype=np.uint8)] = True
    return table
