"""Phrases whose words stand together more often than their parts would have it, from FM-indexes.

The tasks that read documents cut them into shards of one language and about SHARD_BYTES of text.
A shard is stored as its word list and an FM-index over word ids in both directions: the
Burrows-Wheeler transform of the sequence and that of the reversed sequence, with 0 between pieces.
Suffixes are sorted by their first DEPTH words only, which is all that intervals of phrases of
up to DEPTH words need.

Phrases grow by one word a round, to the right in the index of the reversed sequence and to the
left in the other, in turn: the words within an interval of a transform are the extensions, and how
often each stands there is the longer phrase's count. A phrase is only looked for if both phrases it
consists of, without its first and without its last word, have `least` occurrences everywhere, since no
longer phrase is more frequent. Counts are summed across shards by fingerprints of language and phrase,
of twice as many bits as a corpus byte's number has (so about 3 corpora in 10,000 have a frequent phrase
that shares its fingerprint): a shard sends its sorted fingerprints, range by range, as packed gaps with
their counts (about six bytes a phrase); a range's sums go back, as packed, to the shards that have the frequent ones;
and the first of these shards writes the phrase and its count out. No shard's own count decides.
Shards are stored in buckets, so the rounds bring short lists to them and never move them.

Everything else are joins over the frequent phrases: the scores of all cuts, the least of them, and
what a longer phrase explains. No dictionary, phrase list or language passes through the driver or
one task; a language may hold all rows.

Words and languages: see `shards`. A null text has no words; a null lang counts as "und"; repeated
rows count each. Ties rank by count, then by the phrase's bytes. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackmill.llm.arrays import Sums, byte_values, mix, table_bytes, text_blocks, words_of
from trackmill.llm.meet import meet
from trackmill.llm.scratch import CLEAN, Scratch, setting

DEPTH = 4
LEAST = 30
KEEP = 2000
EXPLAINED = 80
SCALE = 2_000_000
SHARD_BYTES = 16 << 20
BUCKET_BYTES = 8 << 20
BATCH_ROWS = 1000
PART_BYTES = 12 << 20
SPREAD = 32
STEP = 1 << 19
#: Pairs are by far the most; their fingerprints travel in two halves, one after the other.
HALVES = (0, 1)

ENDS = table_bytes(b".,;:!?\n\x0b\x0c\r")
WORD = ~(ENDS | table_bytes(b" \t"))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SHARDS = "shard long, lang string, n long, words array<string>, counts array<long>, forward binary, backward binary"
KEPT = "shard long, lang string, known binary, phrases array<string>, f array<long>"


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of a block of texts, and which of them begin a piece."""
    data, offsets = LOWER[data], offsets.astype(np.int64)
    starts, ends, _ = words_of(data, offsets, WORD)
    sizes = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=sizes[1:])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(sizes), pa.py_buffer(data[WORD[data]]))
    marks = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(ENDS[data], out=marks[1:])
    text = np.searchsorted(offsets, starts, "right")
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (marks[starts[1:]] > marks[ends[:-1]]) | (text[1:] != text[:-1])
    return words, new


def transform(sequence: np.ndarray) -> np.ndarray:
    """Burrows-Wheeler transform of a cyclic sequence of ids, its rotations sorted by DEPTH ids."""
    bits = int(sequence.max()).bit_length()
    key = sequence.astype(np.int64)
    if bits * DEPTH <= 63:
        key = sum(np.roll(key, -i) << (bits * (DEPTH - 1 - i)) for i in range(DEPTH))
    else:
        width = 1
        while width < DEPTH:  # ranks of the first `width` ids, doubled
            ranks, key = np.unique(key, return_inverse=True)
            key = key * len(ranks) + np.roll(key, -width)
            width *= 2
    return sequence[np.argsort(key) - 1]


class Index:
    """Intervals of one direction: those of a phrase and of each symbol before it."""

    def __init__(self, transformed: np.ndarray):
        self.bwt, self.n = transformed, len(transformed)
        self.places = transformed * np.int64(self.n)  # symbol by symbol, its places
        self.places += np.arange(self.n)
        self.places.sort()

    def find(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of phrases (one a row), by backward search."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n)
        for c in phrases.T[::-1]:
            low, high = (np.searchsorted(self.places, c * self.n + x) for x in (low, high))
        return low, high

    def before(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all intervals, each symbol that stands before their phrase: interval, symbol, how often."""
        found, ends = [], np.cumsum(high - low)
        first = 0
        while first < len(low):  # as many intervals at once as make STEP rows, or one longer
            done = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + STEP, "right")))
            size = (high - low)[first:last]
            rows = np.arange(int(ends[last - 1]) - done) + np.repeat(low[first:last] - (ends[first:last] - size - done), size)
            keys = np.repeat(np.arange(first, last) * (self.n + 1), size)
            keys += self.bwt[rows]
            found.append(np.unique(keys, return_counts=True))
            first = last
        pairs, counts = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*found, strict=True) if found else ((), ())))
        owner, symbol = pairs // (self.n + 1), pairs % (self.n + 1)
        some = symbol > 0
        return owner[some], symbol[some], counts[some]


def contained(known: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Which rows of `asked` are rows of `known`."""
    k, a = known[:, 0], asked[:, 0]
    top = int(max(known.max(initial=0), asked.max(initial=0))) + 1
    for i in range(1, known.shape[1]):
        if int(max(k.max(initial=0), a.max(initial=0))) * top >= 1 << 62:
            _, rank = np.unique(np.concatenate([k, a]), return_inverse=True)
            k, a = rank[: len(k)], rank[len(k) :]
        k, a = k * top + known[:, i], a * top + asked[:, i]
    return np.isin(a, k)


def shards(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per shard: its words with their counts, and the transforms of either direction.

    A-Z are lowered; texts end their pieces at [.,;:!?\\n-\\r], and words are runs of other bytes than
    space and tab within a piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[str, list] = {}
        size = 0

        def close():
            nonlocal number
            for lang in sorted(held):
                encoded = pa.concat_arrays([w for w, _ in held[lang]]).dictionary_encode()
                ids = encoded.indices.to_numpy().astype(np.int32) + 1
                new = np.concatenate([x for _, x in held[lang]])
                if not len(ids):
                    continue
                sequence = np.zeros(len(ids) + int(new.sum()), dtype=np.int32)
                sequence[np.arange(len(ids)) + np.cumsum(new)] = ids
                number += 1
                counts = np.bincount(ids, minlength=len(encoded.dictionary) + 1)[1:]
                both = [transform(x).tobytes() for x in (sequence, sequence[::-1])]
                pa.default_memory_pool().release_unused()
                row = [number, lang, len(ids), encoded.dictionary.to_pylist(), counts, *both]
                types = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=[c.split()[0] for c in SHARDS.split(", ")])
            held.clear()

        for batch in batches:
            langs = pc.fill_null(batch.column("lang"), "und")
            for lang in pc.unique(langs).to_pylist():
                for _, _, data, offsets in text_blocks(batch.filter(pc.equal(langs, lang)), "text"):
                    held.setdefault(lang, []).append(pieces(data, offsets))
                    size += len(data)
                    if size >= shard_bytes:
                        yield from close()
                        size = 0
        yield from close()

    return docs.select("lang", "text").mapInArrow(run, SHARDS)


class Round:
    """One round: the phrases of `depth` words that a shard can have, from its frequent ones of one word less."""

    def __init__(self, depth: int, part_bits: int, bits: int, half: int | None = None):
        self.depth, self.part_bits, self.bits, self.half = depth, part_bits, bits, half
        self.right = depth % 2 == 0
        self.side = "counts" if depth == 1 else "backward" if self.right else "forward"

    def phrases(self, batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Word ids, counts, fingerprints and their checks of the phrases, and the shard's words."""
        pa.default_memory_pool().release_unused()
        words, side = batch.column("words")[i].values, batch.column("side")[i]
        if self.depth == 1:
            found, counts = np.arange(1, len(words) + 1)[:, None], side.values.to_numpy()
        else:
            known = np.frombuffer(batch.column("known")[i].as_buffer(), dtype=np.int32).reshape(-1, self.depth - 1).astype(np.int64)
            index = Index(np.frombuffer(side.as_buffer(), dtype=np.int32))
            owner, symbol, counts = index.before(*index.find(known[:, ::-1] if self.right else known))
            found = np.column_stack([known[owner], symbol] if self.right else [symbol, known[owner]])
            some = contained(known, found[:, 1:] if self.right else found[:, :-1])
            found, counts = found[some], counts[some]
        lang = hashlib.sha256(batch.column("lang")[i].as_py().encode()).digest()
        prints = []
        for seed in (0, 1):
            of_word = hashes(words, seed)
            value = np.full(len(found), int.from_bytes(lang[8 * seed : 8 * seed + 8], "little"), dtype=np.uint64)
            for c in found.T:
                value = mix(value + of_word[c - 1])
            prints.append(value)
        # a sorted value of up to 64 bits, and a check of up to 32 more
        value, check = prints[0] >> np.uint64(max(0, 64 - self.bits)), prints[1] >> np.uint64(64 - min(max(self.bits - 64, 1), 32))
        return found, counts, value, check * np.uint64(self.bits > 64), words

    def send(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """part, shard and the packed fingerprints of that part with their counts."""
        for batch in batches:
            for i in range(batch.num_rows):
                _, counts, value, check, _ = self.phrases(batch, i)
                if self.half is not None:
                    some = value >> np.uint64(min(self.bits, 64) - 1) == self.half
                    counts, value, check = counts[some], value[some], check[some]
                if not len(value):
                    continue
                order = np.argsort(value)
                value, check, counts = value[order], check[order], counts[order]
                edges = np.searchsorted(value, np.arange(1 << self.part_bits, dtype=np.uint64) << np.uint64(min(self.bits, 64) - self.part_bits))
                edges = np.append(edges, len(value))
                parts = np.flatnonzero(edges[1:] > edges[:-1])
                packed = [pack(value[a:b], check[a:b], counts[a:b]) for a, b in zip(edges[parts].tolist(), edges[parts + 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(parts.astype(np.int32)), pa.repeat(batch.column("shard")[i], len(parts)), pa.array(packed, pa.binary())], names=["part", "shard", "packed"]
                )

    def keep(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shard's frequent phrases, as word ids; and those it is the first shard of, as text with their counts."""
        for batch in batches:
            for i in range(batch.num_rows):
                phrases, _, value, check, words = self.phrases(batch, i)
                value_, check_, told = (np.concatenate(x) for x in zip(*(unpack(x.as_py()) for x in batch.column("replies")[i].values), strict=True))
                order = np.argsort(value_)
                value_, check_, told = value_[order], check_[order], told[order]
                at = np.searchsorted(value_, value)
                last = np.searchsorted(value_, value, "right")
                some = np.flatnonzero(last > at)
                for j in np.flatnonzero(last - at > 1):  # fingerprints that differ in the check only
                    at[j] += int((check_[at[j] : last[j]] == check[j]).argmax())
                some = some[check_[at[some]] == check[some]]
                phrases, told = phrases[some], told[at[some]]
                own = (told & 1).astype(bool)
                text = pc.binary_join_element_wise(*(words.take(pa.array(c - 1)) for c in phrases[own].T), " ")
                row = [pa.array([x]) for x in (batch.column("shard")[i].as_py(), batch.column("lang")[i].as_py(), phrases.astype(np.int32).tobytes())]
                lists = [pa.ListArray.from_arrays(pa.array([0, int(own.sum())], pa.int32()), x) for x in (text.cast(pa.string()), pa.array(told[own] >> 1))]
                yield pa.RecordBatch.from_arrays([*row, *lists], names=[c.split()[0] for c in KEPT.split(", ")])


def hashes(words: pa.Array, seed: int) -> np.ndarray:
    """A 64-bit value per word."""
    large = words.cast(pa.large_string())
    if not len(large):
        return np.zeros(0, dtype=np.uint64)
    offsets = np.frombuffer(large.buffers()[1], dtype=np.int64)[large.offset : large.offset + len(large) + 1]
    data = np.frombuffer(large.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return Sums(byte_values(data, seed), seed).of(offsets[:-1] - offsets[0], offsets[1:] - offsets[0])


def _least_width(x: np.ndarray) -> np.dtype:
    return next(d for d in map(np.dtype, ("<u1", "<u2", "<u4", "<u8")) if int(x.max(initial=0)) <= np.iinfo(d).max)


def pack(values: np.ndarray, checks: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted fingerprints as gaps, with their checks and counts, compressed."""
    columns = [np.diff(values, prepend=np.uint64(0)), checks, counts]
    kinds = [_least_width(x) for x in columns]
    body = b"".join(_planes(x, k) for x, k in zip(columns, kinds, strict=True))
    return struct.pack("<QBBB", len(values), *(k.itemsize for k in kinds)) + pa.Codec("zstd").compress(body, asbytes=True)


def _planes(x: np.ndarray, kind: np.dtype) -> bytes:
    """Byte by byte of significance, so that bytes of like distribution stand together."""
    return x.astype(kind).view(np.uint8).reshape(len(x), kind.itemsize).T.tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, *widths = struct.unpack_from("<QBBB", data)
    body = pa.Codec("zstd").decompress(data[11:], decompressed_size=n * sum(widths), asbytes=True)
    out, at = [], 0
    for w in widths:
        planes = np.frombuffer(body, np.uint8, n * w, at).reshape(w, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{w}").reshape(n).astype(np.uint64))
        at += n * w
    return np.cumsum(out[0], dtype=np.uint64), out[1], out[2].astype(np.int64)


def _sums(least: int):
    """To each shard and part its fingerprints of at least `least` occurrences, with twice that count, plus 1 for the first shard.

    Rows come sorted by part and shard; one part at a time is held.
    """

    def close(rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        opened = [unpack(x) for _, x in rows]
        values, checks, counts = (np.concatenate(x) for x in zip(*opened, strict=True))
        _, first, at = np.unique(values, return_index=True, return_inverse=True)
        if (checks != checks[first[at]]).any():
            both = np.empty(len(values), dtype=[("v", "<u8"), ("c", "<u8")])
            both["v"], both["c"] = values, checks
            _, first, at = np.unique(both, return_index=True, return_inverse=True)
        total = np.bincount(at, weights=counts).astype(np.int64)
        told = 2 * total[at]
        told[first] += 1
        enough = total[at] >= least
        shards, packed, begin = [], [], 0
        for (shard, _), (v, c, _) in zip(rows, opened, strict=True):
            some, mine = enough[begin : begin + len(v)], told[begin : begin + len(v)]
            if some.any():
                shards.append(shard)
                packed.append(pack(v[some], c[some], mine[some]))
            begin += len(v)
        yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(packed, pa.binary())], names=["shard", "reply"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = [], None
        for batch in batches:
            for p, shard, packed in zip(*(batch.column(c).to_pylist() for c in ("part", "shard", "packed")), strict=True):
                if p != part and held:
                    yield from close(held)
                    held = []
                part = p
                held.append((shard, packed))
        if held:
            yield from close(held)

    return run


def frequent(docs: DataFrame, scratch: Scratch, least: int = LEAST, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to DEPTH words with at least `least` occurrences (lang, phrase, f, size), and all words per lang (lang, n)."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    part_bits, bits = (size // PART_BYTES).bit_length(), max(48, 2 * size.bit_length() - 4)
    buckets = max(4, -(-size // BUCKET_BYTES))
    table = f"phrases_{uuid.uuid4().hex}"
    try:
        with setting(spark, CLEAN, "true"), setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS)):
            shards(docs, shard_bytes).write.format("parquet").option("compression", "zstd").option("path", f"{scratch.root}/shards").bucketBy(buckets, "shard").saveAsTable(table)
        stored = spark.table(table)
        totals = scratch.save("totals", stored.groupBy("lang").agg(F.sum("n").alias("n")))
        return _rounds(stored, scratch, least, part_bits, bits, buckets), totals
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        scratch.drop("shards")


def _rounds(stored: DataFrame, scratch: Scratch, least: int, part_bits: int, bits: int, buckets: int) -> DataFrame:
    grams, kept = None, None
    for depth in range(1, DEPTH + 1):
        step = Round(depth, part_bits, bits)
        source = stored.select("shard", "lang", "words", F.col(step.side).alias("side"))
        if kept is not None:
            source = source.join(kept.select("shard", "known").repartition(buckets, "shard").hint("shuffle_hash"), "shard")
        told = None
        for half in HALVES if depth == 2 else (None,):
            parts = source.mapInArrow(Round(depth, part_bits, bits, half).send, "part int, shard long, packed binary")
            parts = parts.repartition(max(buckets, 1 << part_bits), "part").sortWithinPartitions("part", "shard")
            part = scratch.save(f"told-{depth}-{half}", parts.mapInArrow(_sums(least), "shard long, reply binary"))
            told = part if told is None else told.union(part)
        replies = told.repartition(buckets, "shard").groupBy("shard").agg(F.collect_list("reply").alias("replies"))
        kept = scratch.save(f"kept-{depth}", source.join(replies.hint("shuffle_hash"), "shard").mapInArrow(step.keep, KEPT))
        rows = kept.select("lang", F.explode(F.arrays_zip("phrases", "f")).alias("x"))
        sums = scratch.save(f"grams-{depth}", rows.select("lang", F.col("x.phrases").alias("phrase"), F.col("x.f").alias("f"), F.lit(depth).alias("size")))
        grams = sums if grams is None else grams.union(sums)
        scratch.drop(f"kept-{depth - 1}", *(f"told-{depth}-{half}" for half in (None, *HALVES)))
    scratch.drop(f"kept-{DEPTH}")
    return grams


def collocations(docs: DataFrame, least: int = LEAST, explained: int = EXPLAINED, keep: int = KEEP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The first `keep` phrases of each lang: lang, rank, phrase, a, l, r, n and score.

    a is the phrase's count; cut after k words, l and r are the counts of its parts and the score is
    floor(SCALE * a / (l + r)), of all cuts the least (of equal ones the first). Phrases that stand
    inside a longer one with at least `explained` per cent of their count are left out; by the
    counts' order it is enough to look at phrases that are longer by one word.
    """
    scratch = Scratch(docs.sparkSession)
    grams, totals = frequent(docs, scratch, least, shard_bytes)
    longer = grams.filter("size > 2").select("lang", "size", F.col("f").alias("most"), F.split("phrase", " ").alias("w"))
    inner = F.array(F.expr("slice(w, 1, size - 1)"), F.expr("slice(w, 2, size - 1)"))
    within = longer.select("lang", "most", F.explode(inner).alias("w")).groupBy("lang", F.array_join("w", " ").alias("phrase")).agg(F.max("most").alias("most"))
    candidates = grams.filter("size > 1").join(within, ["lang", "phrase"], "left")
    hundred = F.lit(100).cast("decimal(10,0)")
    candidates = candidates.filter(F.col("most").isNull() | (hundred * F.col("most") < F.lit(explained).cast("decimal(10,0)") * F.col("f")))
    parts = candidates.select("lang", "phrase", F.col("f").alias("a"), "size", F.split("phrase", " ").alias("w"), F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    parts = parts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("left"), F.expr("array_join(slice(w, k + 1, size - k), ' ')").alias("right"))
    parts = scratch.save("parts", parts)
    counts = grams.filter(F.col("size") < DEPTH)
    parts = scratch.save("lefts", meet(parts, counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]))
    parts = scratch.save("rights", meet(parts, counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"]))
    score = F.expr(f"CAST({SCALE} AS DECIMAL(10,0)) * a div (l + r)")
    best = parts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = best.select("lang", "phrase", "a", "b.l", "b.r", "b.score", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD)).alias("spread"))
    for keys in (["lang", "spread"], ["lang"]):  # a lang's first ones are among the first ones of its shares
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= keep)
    return rows.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def sql(least: int = LEAST, explained: int = EXPLAINED, keep: int = KEEP) -> str:
    """DuckDB SQL of collocations()."""
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({lowered}, '[.,;:!?\\n-\\r]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS f
  FROM places, (SELECT unnest(range(1, {DEPTH} + 1)) AS size) WHERE i + size - 1 <= len(w) GROUP BY ALL HAVING count(*) >= {least}),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
longer AS (SELECT lang, size, f, string_split(phrase, ' ') AS w FROM grams WHERE size > 2),
within AS (
  SELECT lang, phrase, max(f) AS most
  FROM (SELECT lang, f, array_to_string(w[1:size - 1], ' ') AS phrase FROM longer UNION ALL
        SELECT lang, f, array_to_string(w[2:size], ' ') AS phrase FROM longer) GROUP BY ALL),
candidates AS (
  SELECT g.lang, g.phrase, g.f AS a, g.size, string_split(g.phrase, ' ') AS w
  FROM grams g LEFT JOIN within x USING (lang, phrase)
  WHERE g.size > 1 AND (x.most IS NULL OR 100 * CAST(x.most AS HUGEINT) < {explained} * CAST(g.f AS HUGEINT))),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS p, array_to_string(w[k + 1:], ' ') AS q
  FROM candidates, (SELECT unnest(range(1, {DEPTH})) AS k) WHERE k < size),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, CAST({SCALE} * CAST(c.a AS HUGEINT) // (x.f + y.f) AS BIGINT) AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = c.p JOIN grams y ON y.lang = c.lang AND y.phrase = c.q),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {keep}"""
