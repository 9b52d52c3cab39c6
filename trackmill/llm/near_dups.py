"""Near copies by order MinHash, verified by banded alignment.

For each of SKETCHES random orders, a text's sketch is its ORDER smallest shingles (SHINGLE
consecutive words; A-Z in lower case, marks ignored), each labelled with its occurrence number
so repeats count, written in text order: two texts share a sketch only if they share those
shingles in the same order, which makes the sketch sensitive to edits and moves (Marcais et al.
2019). Texts that share a sketch are compared: their words are aligned within the band that the
threshold leaves, and with m words aligned the similarity is m / (n_a + n_b - m). Texts at
THRESHOLD or more are linked, and a class is a connected component of links.

A pair whose shingles have Jaccard similarity j shares one sketch with chance j^ORDER or so, and
misses all with (1 - j^ORDER)^SKETCHES. Of 4,000 pairs of 200 words at THRESHOLD each, none was
missed with one word in nine replaced at random (j = 0.384) or a tenth of the text moved, and 0.7 %
with every ninth word replaced (j = 0.286, the worst spread). Short texts are missed more often,
as a few edits can break every shingle (the README has counts); members of a group are found
through each other too.

Equal texts are one node, so copies are never expanded into pairs. Within a bucket (texts
sharing a sketch) every text is first compared with one representative, in ROUNDS rounds with
changing representatives; afterwards only pairs of texts that are still in different
components are compared, each pair. So no link between different components is missed, and
a large group of copies costs its size, not its square.

Nulls: rows with a null doc_id have a null class; texts without words (null ones too) are only
equal to themselves and are in a class of their own per doc_id. Texts of fewer than SHINGLE words
are one shingle. Rows with equal doc_id are one document: links of any of them are its links.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trackmill.llm.arrays import Sums, byte_values, mix, signed, text_blocks
from trackmill.llm.decontaminate import word_prints
from trackmill.llm.scratch import Scratch, free_name

SHINGLE = 5
THRESHOLD = 0.8
#: Chosen by the chance to miss a pair at THRESHOLD: with one word in nine replaced j is about 0.384, and (1 - j^2)^64 is 4e-5.
SKETCHES = 64
ORDER = 2
ROUNDS = 3
BINS = 128

_SEEDS = np.random.default_rng(7).integers(1, 2**63, size=256, dtype=np.uint64) | np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all texts' shingles, and how many precede each text."""
    words, counts = word_prints(data, offsets)
    n = np.diff(counts)
    per_text = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    before = np.concatenate([[0], np.cumsum(per_text)])
    text = np.repeat(np.arange(len(n)), per_text)
    starts = counts[:-1][text] + np.arange(before[-1]) - before[:-1][text]
    stops = np.minimum(starts + size, counts[1:][text])
    return Sums(words).of(starts, stops), before


def _labelled(prints: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Shingles together with their occurrence number within the text."""
    order = np.lexsort((prints, text))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (prints[order][1:] != prints[order][:-1]) | (text[order][1:] != text[order][:-1])
    places = np.arange(len(order))
    number = np.empty(len(order), dtype=np.uint64)
    number[order] = (places - np.maximum.accumulate(np.where(new, places, 0))).astype(np.uint64)
    return mix(prints + number * np.uint64(0x9E3779B97F4A7C15))


def sketches(prints: np.ndarray, before: np.ndarray, n_sketches: int = SKETCHES, size: int = ORDER) -> np.ndarray:
    """A row per text that has shingles, a column per sketch."""
    filled = np.flatnonzero(np.diff(before))
    starts, n = before[:-1][filled], np.diff(before)[filled]
    text = np.repeat(np.arange(len(filled)), n)
    labelled = _labelled(prints, text)
    out = np.empty((len(filled), n_sketches), dtype=np.uint64)
    worst = np.uint64(2**64 - 1)
    for k in range(n_sketches):
        rank = (labelled ^ _SEEDS[k]) * _SEEDS[-1 - k]
        rank ^= rank >> np.uint64(29)
        chosen = np.full((len(filled), size), len(prints), dtype=np.int64)
        for i in range(size):
            least = np.minimum.reduceat(rank, starts)
            at = np.flatnonzero(rank == least[text])
            at = at[rank[at] != worst]
            chosen[text[at], i] = at
            rank[at] = worst
        chosen.sort(axis=1)  # text order
        there = np.concatenate([labelled, [np.uint64(0)]])[chosen]
        key = np.full(len(filled), _SEEDS[k], dtype=np.uint64)
        for i in range(size):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + there[:, i])
        out[:, k] = key
    return out


def aligned(a: list[int], b: list[int], band: int) -> int:
    """The most words that a and b share in order, among alignments that stray at most `band` places.

    Bit-parallel longest common subsequence over the window of a's places that the band allows
    for each place of b.
    """
    at: dict[int, list[int]] = defaultdict(list)
    for i, x in enumerate(a):
        at[x].append(i)
    width = 2 * band + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    window, low, passed = full, -band, 0
    for x in b:
        places = at.get(x)
        if places:
            same = 0
            for i in places[bisect_left(places, low) :]:
                if i >= low + width:
                    break
                same |= 1 << (i - low)
            met = window & same
            window = ((window + met) | (window & ~same)) & full
        if not window & 1:
            passed += 1
        window = (window >> 1) | top
        low += 1
    return passed + width - window.bit_count()


def similarity(a: list[int], b: list[int], threshold: float) -> float:
    """Aligned words over all words; 0 where it is certainly below the threshold."""
    n, m = len(a), len(b)
    least = threshold * (n + m) / (1 + threshold)  # words that have to be aligned
    if min(n, m) < least - 1e-9:
        return 0.0
    start = 0
    while start < min(n, m) and a[start] == b[start]:
        start += 1
    stop = 0
    while stop < min(n, m) - start and a[n - 1 - stop] == b[m - 1 - stop]:
        stop += 1
    shared = start + stop
    if shared < min(n, m):
        band = int(n + m - 2 * least) + 1
        shared += aligned(a[start : n - stop], b[start : m - stop], min(band, max(n, m)))
    return shared / (n + m - shared)


def _describe(batches):
    for batch in batches:
        ids = batch.column("doc_id")
        for first, last, data, offsets in text_blocks(batch, "text"):
            prints, before = shingles(data, offsets, SHINGLE)
            keys = np.zeros((last - first, SKETCHES), dtype=np.uint64)
            words, counts = word_prints(data, offsets)
            n = np.diff(counts)
            bins = np.repeat(np.arange(last - first), n) * BINS + (mix(words) >> np.uint64(57)).astype(np.int64)
            bags = np.minimum(np.bincount(bins, minlength=(last - first) * BINS), 127).astype(np.int8)  # a smaller difference keeps the bound
            if len(prints):
                keys[n > 0] = sketches(prints, before)
            texts = [Sums(byte_values(data, seed), seed).of(offsets[:-1], offsets[1:]) for seed in (0, 1)]
            bags = pa.ListArray.from_arrays(pa.array(np.arange(last - first + 1, dtype=np.int32) * BINS), pa.array(bags))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(last - first + 1, dtype=np.int32) * SKETCHES), pa.array(signed(keys.ravel())))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, last - first), pa.array(signed(texts[0])), pa.array(signed(texts[1])), pa.array(n.astype(np.int64)), lists, bags],
                names=["doc_id", "h1", "h2", "n", "keys", "bag"],
            )


def _sequences(batches):
    for batch in batches:
        ids = batch.column("id")
        for first, last, data, offsets in text_blocks(batch, "text"):
            prints, before = word_prints(data, offsets)
            parts = [prints[before[i] : before[i + 1]].tobytes() for i in range(last - first)]
            yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), pa.array(parts, pa.binary())], names=["id", "seq"])


def _links(threshold: float):
    def run(batches):
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            good, held, last = [], None, None
            for x, y, s, t in zip(a, b, batch.column("seq_a"), batch.column("seq_b"), strict=True):
                if x != last:
                    held, last = np.frombuffer(s.as_buffer(), np.uint64).tolist(), x
                good.append(similarity(held, np.frombuffer(t.as_buffer(), np.uint64).tolist(), threshold) >= threshold)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(good)], names=["a", "b", "good"])

    return run


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Per node of edges (a, b): the smallest node of its component, as (id, class).

    Labels spread along edges and then along labels, so their reach doubles; they only
    decrease, and an unchanged sum ends the rounds.
    """
    both = scratch.save(f"{name}-edges", edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = scratch.save(f"{name}-0", both.groupBy("a").agg(F.min("b").alias("c")).select(F.col("a").alias("id"), F.least("a", "c").alias("class")))
    total, i = None, 0
    while True:
        now = labels.agg(F.sum(F.col("class").cast("decimal(38,0)"))).first()[0]
        if now == total:
            break
        total, i = now, i + 1
        near = both.join(labels.select(F.col("id").alias("b"), "class"), "b").groupBy("a").agg(F.min("class").alias("near"))
        near = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.least("class", "near").alias("class"))
        beyond = labels.select(F.col("id").alias("class"), F.col("class").alias("beyond"))
        labels = scratch.save(f"{name}-{i}", near.join(beyond, "class").select("id", F.least("class", "beyond").alias("class")))
        scratch.drop(f"{name}-{i - 1}")
    scratch.drop(f"{name}-edges")
    return labels


def _alike(threshold: float):
    """Whether texts of n and m words allow the threshold at all.

    The words that are not aligned are at least as many as the bags of words (counts by hash) differ by.
    """
    apart = F.aggregate(F.zip_with("bag", "other_bag", lambda x, y: F.abs(x - y)), F.lit(0), lambda a, x: a + x)
    most = (F.col("n") + F.col("m")) * ((1 - threshold) / (1 + threshold)) + 1e-6
    return (F.least("n", "m") >= F.greatest("n", "m") * threshold) & (apart <= most)


def classes(docs: DataFrame, threshold: float = THRESHOLD, rounds: int = ROUNDS, scratch: Scratch | None = None) -> DataFrame:
    """Per row: doc_id and class_id, the smallest doc_id of its component of near copies."""
    scratch = scratch or Scratch(docs.sparkSession)
    rows = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull())
    texts = scratch.save("texts", rows.mapInArrow(_describe, "doc_id long, h1 long, h2 long, n long, keys array<long>, bag array<tinyint>"))
    # equal texts: one node, the smallest id that has the text
    nodes = scratch.save("nodes", texts.groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.max("n").alias("n"), F.min("keys").alias("keys"), F.min("bag").alias("bag")))
    of_text = texts.filter("n > 0").select("doc_id", "h1", "h2").join(nodes.select("h1", "h2", "id"), ["h1", "h2"]).select("doc_id", "id")
    same = scratch.save("same", of_text.filter("doc_id != id").distinct())
    keyed = nodes.filter("n > 0").select("id", F.explode("keys").alias("key"))
    crowded = keyed.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    buckets = scratch.save("buckets", keyed.join(crowded, "key").join(nodes.select("id", "n", "bag"), "id"))
    met = buckets.select("id").distinct()
    sequences = rows.withColumnRenamed("doc_id", "id").join(met, "id", "left_semi").mapInArrow(_sequences, "id long, seq binary")
    sequences = scratch.save("sequences", sequences)
    scratch.drop("texts")

    done = None  # pairs that were compared
    links = same.select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    labels = None
    for r in range(rounds + 1):
        open_rows = buckets if labels is None else scratch.save(f"open-{r}", _unresolved(buckets, labels))
        pairs = _star(open_rows, r, threshold) if r < rounds else _rest(open_rows, threshold)
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = scratch.save(f"pairs-{r}", pairs.distinct())
        if r and pairs.isEmpty():
            if r < rounds:
                continue
            break
        compared = _compare(pairs, sequences, threshold)
        compared = scratch.save(f"compared-{r}", compared)
        done = compared.select("a", "b").distinct() if done is None else done.union(compared.select("a", "b").distinct())
        links = links.union(compared.filter("good").select("a", "b"))
        labels = components(links, scratch, f"classes-{r}")
    scratch.drop("nodes", "same", "buckets", "sequences", *(f"{kind}-{r}" for kind in ("open", "pairs", "compared") for r in range(rounds + 1)))
    named = rows.select("doc_id").join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("class_id", F.coalesce("class", "doc_id"))
    return named.select("doc_id", "class_id")


def _unresolved(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the buckets whose texts are not all in one component yet, with their components."""
    rows = buckets.select("key", "id", "n", "bag").join(labels, "id", "left").withColumn("class", F.coalesce("class", "id"))
    mixed = rows.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo < hi").select("key")
    return rows.join(mixed, "key")


def _star(rows: DataFrame, r: int, threshold: float) -> DataFrame:
    """Each text of a bucket with the bucket's representative of round r."""
    if "class" not in rows.columns:
        rows = rows.withColumn("class", F.col("id"))
    pick = F.min(F.struct((F.col("id") if r == 0 else F.xxhash64(F.lit(r), "key", "id")).alias("by"), "id", "n", "class", "bag")).alias("rep")
    reps = rows.groupBy("key").agg(pick).select("key", F.col("rep.id").alias("rep"), F.col("rep.n").alias("m"), F.col("rep.class").alias("rep_class"), F.col("rep.bag").alias("other_bag"))
    pairs = rows.join(reps, "key").filter((F.col("class") != F.col("rep_class")) & _alike(threshold))
    return pairs.select(F.least("id", "rep").alias("a"), F.greatest("id", "rep").alias("b"))


def _rest(rows: DataFrame, threshold: float) -> DataFrame:
    """All pairs of texts of a bucket that are still in different components."""
    rows = rows.join(rows.groupBy("id").agg(F.collect_set("key").alias("keys")), "id")  # at most SKETCHES of them
    other = rows.select("key", F.col("keys").alias("other_keys"), F.col("id").alias("b"), F.col("n").alias("m"), F.col("bag").alias("other_bag"), F.col("class").alias("other"))
    once = F.col("key") == F.array_min(F.array_intersect("keys", "other_keys"))  # a pair of several buckets counts in one
    pairs = rows.join(other, "key").filter((F.col("id") < F.col("b")) & (F.col("class") != F.col("other")) & _alike(threshold) & once)
    return pairs.select(F.col("id").alias("a"), "b")


def _compare(pairs: DataFrame, sequences: DataFrame, threshold: float) -> DataFrame:
    both = pairs.join(sequences.select(F.col("id").alias("b"), F.col("seq").alias("seq_b")), "b").join(sequences.select(F.col("id").alias("a"), F.col("seq").alias("seq_a")), "a")
    return both.mapInArrow(_links(threshold), "a long, b long, good boolean")


def near_dups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id and class_id, the smallest doc_id among its near copies."""
    return classes(docs, threshold).union(docs.filter(F.col("doc_id").isNull()).select("doc_id", F.lit(None).cast("long").alias("class_id")))


def keep_first(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the near copies of a document with a smaller id, in the columns of docs.

    Of several rows with the kept document's id all stay; rows with a null id stay.
    """
    scratch = Scratch(docs.sparkSession)
    name = free_name(docs, "copy_id")
    copies = scratch.save("copies", classes(docs, threshold, scratch=scratch).filter("class_id < doc_id").select(F.col("doc_id").alias(name)).distinct())
    return docs.join(copies, F.col("doc_id") == F.col(name), "left_anti")
