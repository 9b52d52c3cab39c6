"""Token ids on disk: one flat id array per shard, with Elias-Fano coded document boundaries.

Documents are dealt by range of doc_id into shards; each task writes two files in the shared
folder and one row of the manifest:

    shard-NNNNN.ids   the documents' ids joined, little-endian unsigned, 2 or 4 bytes each
    shard-NNNNN.ef    the doc ids and the ends of the documents, each an Elias-Fano sequence

An Elias-Fano sequence of n non-decreasing numbers up to u keeps the low log2(u/n) bits of each
in a packed array and the rest as a bit vector with n ones among at most 3n bits, so about
2 + log2(u/n) bits per document. `select` finds the i-th number from the position of every
SAMPLE-th one, without a table of 64-bit offsets. Files are written under a name of the task
attempt and then renamed, so a repeated task replaces its own output.

Nulls: a null text is an empty one (its only id is the end id). Rows with a null doc_id come
first and read back with a null doc_id. Rows of equal doc_id are ordered by text. An empty table
gives no shards and no rows. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackmill.llm.arrays import table_bytes, text_blocks
from trackmill.llm.scratch import Scratch

END_ID = 2
SHARD_BYTES = 16 << 20
SAMPLE = 256
#: Units of one of the two generations that an encoder keeps, and the bytes of the longest.
CACHED_UNITS = 250_000
LONGEST_KEPT = 64
#: Bytes of text whose units are told apart at once.
UNIT_BLOCK = 4 << 20

SPACES = b"\t\n\x0b\x0c\r "
#: ASCII that is neither letter, digit nor white space.
MARKS = bytes(b for b in range(128) if not chr(b).isalnum() and b not in SPACES)
IS_SPACE, IS_MARK = table_bytes(SPACES), table_bytes(MARKS)
IS_LETTER = table_bytes(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
#: White space beyond ASCII, of two and of three bytes, as big-endian numbers.
WIDE_SPACES = [int.from_bytes(c.encode(), "big") for c in ("\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000")]
BEGINS_WIDE = table_bytes(b"\xc2\xe1\xe2\xe3")
#: The pieces that the byte-level tokenizer cuts a unit of ASCII into.
PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+")


def spaces(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 belong to white space."""
    space = IS_SPACE[data]
    at = np.flatnonzero(BEGINS_WIDE[data])
    if len(at):
        padded = np.append(data, np.zeros(2, np.uint8)).astype(np.int32)
        char = padded[at] << 16 | padded[at + 1] << 8 | padded[at + 2]
        two, three = at[np.isin(char >> 8, WIDE_SPACES)], at[np.isin(char, WIDE_SPACES)]
        space[np.concatenate([two, two + 1, three, three + 1, three + 2])] = True
    return space


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the units of texts joined to `data` start; they cover all bytes and never cross texts.

    A unit is a word with the space before it, the rest of a word from a mark after an ASCII letter
    on, or white space. Of more white space before a word the last character is apart; a space
    goes with the word.
    """
    space = spaces(data)
    head = np.zeros(len(data), dtype=bool)
    head[offsets[:-1][offsets[:-1] < len(data)]] = True
    cut = head.copy()
    cut[1:] |= space[1:] != space[:-1]
    words = np.flatnonzero(cut & ~space & ~head)
    cut[1:] |= IS_LETTER[data[:-1]] & IS_MARK[data[1:]]
    last = words - 1
    for _ in range(2):  # white space has at most three bytes
        last -= (data[last] & 0xC0) == 0x80
    cut[last] = True
    cut[words[data[words - 1] == ord(" ")]] = False
    return np.flatnonzero(cut)


class Encoder:
    """Ids of whole texts as bytes; the ids of a unit of text (a word and its space) are kept.

    The byte-level tokenizer cuts at every unit's edge before it looks for merges, so units can be
    encoded one by one: of a block of texts each distinct unit is looked up, or encoded by the
    tokenizer's model, and its ids are gathered by index. Units are kept in two generations; the
    older one is dropped when the younger is full, so the frequent ones stay. Texts that contain a
    special token's string are encoded whole.
    """

    def __init__(self, tokenizer_file: str, width: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.model = self.tokenizer.model
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype(f"<u{width}")
        self.units: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.packed = [i.to_bytes(width, "little") for i in range(self.tokenizer.get_vocab_size())]
        # the byte-level alphabet writes each byte as one printable character
        later = (c for c in map(chr, range(256, 512)))
        shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        self.alphabet = {b: chr(b) if b in shown else next(later) for b in range(256)}

    def _whole(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, dtype=self.kind).tobytes()

    def _merged(self, shown: str) -> bytes:
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(shown)])

    def _piece(self, piece: bytes) -> bytes:
        """Ids of what is one piece for the model."""
        return self._merged(piece.decode("latin-1").translate(self.alphabet))

    def _unit(self, unit: bytes) -> bytes:
        """Ids of one unit. Letters after at most one space are one piece for the model, and so are
        marks at a unit's end; other units with characters beyond ASCII go through the whole tokenizer."""
        if unit.removeprefix(b" ").isalpha():
            return self._merged(unit.decode().replace(" ", self.alphabet[32]))
        if unit.isascii():
            pieces = PIECES.findall(unit)
        else:
            word = unit.rstrip(MARKS)
            if not word.removeprefix(b" ").decode().isalpha():
                return self._whole(unit)
            pieces = [word, unit[len(word) :]] if len(word) < len(unit) else [word]
        return self._piece(unit) if len(pieces) == 1 else b"".join([self._known(p, self._piece) for p in pieces])

    def _known(self, unit: bytes, encode: Callable[[bytes], bytes]) -> bytes:
        ids = self.units.get(unit)
        if ids is None:
            ids = self.older.get(unit) or encode(unit)
            if len(unit) <= LONGEST_KEPT:
                if len(self.units) >= CACHED_UNITS:
                    self.units, self.older = {}, self.units
                self.units[unit] = ids
        return ids

    def encode_all(self, batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
        """The ids of each text of a batch, in its order."""
        for _, _, data, offsets in text_blocks(batch, column, UNIT_BLOCK):
            starts = unit_starts(data, offsets)
            units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)]).dictionary_encode()
            known = self.units
            distinct = [known[u] if u in known else self._known(u, self._unit) for u in units.dictionary.to_numpy(zero_copy_only=False).tolist()]
            ids = pa.array(distinct, pa.large_binary()).take(units.indices)
            ends = np.frombuffer(ids.buffers()[1], dtype=np.int64)[ids.offset : ids.offset + len(ids) + 1]
            ends, ids = ends[np.searchsorted(starts, offsets)].tolist(), memoryview(ids.buffers()[2] or b"")
            raw = data.tobytes()
            special = any(s in raw for s in self.special)
            for i, (start, stop) in enumerate(itertools.pairwise(ends)):
                text = raw[offsets[i] : offsets[i + 1]] if special else b""
                yield self._whole(text) if any(s in text for s in self.special) else bytes(ids[start:stop])

    def encode(self, text: str) -> bytes:
        return next(self.encode_all(pa.record_batch([pa.array([text], pa.large_string())], names=["text"])))


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def _encoder(tokenizer_file: str, width: int) -> Encoder:
    """One encoder per worker process, so tasks find the units of the tasks before them."""
    key = (tokenizer_file, width)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(tokenizer_file, width)
    return _ENCODERS[key]


class EliasFano:
    """A non-decreasing sequence of non-negative integers in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)[None, :]) & np.uint64(1)
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1 if n else 0, dtype=np.uint8)
        high[places] = 1
        return cls(n, low_bits, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"), np.packbits(high, bitorder="little"), places[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return struct.pack("<QQQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        n, low_bits, n_low, n_high, n_samples = struct.unpack_from("<QQQQQ", data, at)
        at += 40
        low = np.frombuffer(data, np.uint8, n_low, at)
        high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        samples = np.frombuffer(data, "<u4", n_samples, at + n_low + n_high)
        return cls(n, low_bits, low, high, samples), at + n_low + n_high + 4 * n_samples

    def _low(self, i: np.ndarray) -> np.ndarray:
        places = i[:, None] * self.low_bits + np.arange(self.low_bits)
        bits = (self.low[places >> 3] >> (places & 7).astype(np.uint8)) & 1
        return (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """The i-th number: from the nearest sample, count ones in the high bits."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        while left:
            window = np.unpackbits(self.high[at // 8 : at // 8 + 64], bitorder="little")[at % 8 + 1 :]
            ones = np.flatnonzero(window)
            if len(ones) >= left:
                at += int(ones[left - 1]) + 1
                left = 0
            else:
                left -= len(ones)
                at += len(window)
        return ((at - i) << self.low_bits) | int(self._low(np.array([i]))[0])

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        i = np.arange(self.n)
        return ((places[: self.n] - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)


MAGIC = b"TIDS0001"


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def _write_shard(folder: str, shard: int, rows: Iterator[tuple[int | None, bytes]], width: int) -> tuple[int, int]:
    """Write one shard from (doc_id, ids) in order; documents and ids written."""
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    own = uuid.uuid4().hex
    docs, ends, n_null, total = [], [], 0, 0
    with store.open_output_stream(f"{root}/.{own}.ids") as out:
        for doc_id, ids in rows:
            out.write(ids)
            total += len(ids) // width
            ends.append(total)
            if doc_id is None:
                n_null += 1
            else:
                docs.append(doc_id)
    low = docs[0] if docs else 0
    gaps = np.array([d - low for d in docs], dtype=np.uint64)
    index = MAGIC + struct.pack("<BQq", width, n_null, low) + EliasFano.of(gaps).to_bytes() + EliasFano.of(np.array(ends, dtype=np.uint64)).to_bytes()
    with store.open_output_stream(f"{root}/.{own}.ef") as out:
        out.write(index)
    for end in ("ids", "ef"):
        target = f"{root}/shard-{shard:05d}.{end}"
        if store.get_file_info(target).type == fs.FileType.File:  # of an attempt whose executor was lost
            store.delete_file(target)
        store.move(f"{root}/.{own}.{end}", target)
    return len(ends), total


def _read_index(folder: str, shard: int) -> tuple[int, list[int | None], EliasFano]:
    store, root = _store(folder)
    with store.open_input_stream(f"{root}/shard-{shard:05d}.ef") as f:
        data = f.read()
    if data[:8] != MAGIC:
        raise ValueError("not an index of token ids")
    width, n_null, low = struct.unpack_from("<BQq", data, 8)
    docs, at = EliasFano.from_bytes(data, 8 + 17)
    ends, _ = EliasFano.from_bytes(data, at)
    return width, [None] * n_null + [low + int(g) for g in docs.all()], ends


def read_document(folder: str, shard: int, i: int) -> np.ndarray:
    """The ids of the i-th document of a shard, found through `select`."""
    width, _, ends = _read_index(folder, shard)
    start, stop = (ends.select(i - 1) if i else 0), ends.select(i)
    store, root = _store(folder)
    with store.open_input_file(f"{root}/shard-{shard:05d}.ids") as f:
        f.seek(start * width)
        return np.frombuffer(f.read((stop - start) * width), dtype=f"<u{width}")


def write(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int = END_ID, width: int = 2, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode and write all documents; the manifest: shard, n_docs, n_ids.

    width: bytes of an id, 2 for vocabularies up to 65,536. The manifest is computed once per
    evaluation of the returned DataFrame and should be saved.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    ordered = docs.select("doc_id", "text").repartitionByRange(shards, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))

    def run(batches):
        from pyspark import TaskContext

        encoder = _encoder(tokenizer_file, width)
        tail = np.array([end_id], dtype=encoder.kind).tobytes()

        def rows():
            for batch in batches:
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode_all(batch), strict=True):
                    yield doc_id, ids + tail

        shard = TaskContext.get().partitionId()
        n_docs, n_ids = _write_shard(folder, shard, rows(), width)
        if n_docs:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (shard, n_docs, n_ids)], names=["shard", "n_docs", "n_ids"])

    return ordered.mapInArrow(run, "shard long, n_docs long, n_ids long")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and the CRC-32 of its ids as 32-bit integers."""
    starts = manifest.withColumn("before", F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids"))

    def run(batches):
        for batch in batches:
            for shard, before in zip(batch.column("shard").to_pylist(), batch.column("before").to_pylist(), strict=True):
                width, docs, ends = _read_index(folder, shard)
                ends = ends.all().astype(np.int64)
                begins = np.concatenate([[0], ends[:-1]])
                store, root = _store(folder)
                with store.open_input_stream(f"{root}/shard-{shard:05d}.ids", buffer_size=1 << 20) as f:
                    for first in range(0, len(docs), 4096):
                        sums = [zlib.crc32(np.frombuffer(f.read(int(n) * width), dtype=f"<u{width}").astype("<u4")) for n in (ends - begins)[first : first + 4096]]
                        part = slice(first, first + len(sums))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(docs[part], pa.int64()), pa.array(begins[part] + before), pa.array((ends - begins)[part]), pa.array(sums, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    spread = starts.select("shard", "before").repartition(F.col("shard"))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens(docs: DataFrame, tokenizer_file: str, folder: str | None = None, **options) -> DataFrame:
    """Write docs as token files in `folder` (else in the shared folder) and read them back."""
    scratch = Scratch(docs.sparkSession)
    folder = folder or f"{scratch.root}/tokens"
    manifest = scratch.save("manifest", write(docs, folder, tokenizer_file, **options))
    return read(manifest, folder)


def tokenizer_path(spark: SparkSession | None = None) -> str:
    """The byte-level vocabulary among the installed tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
