"""Toxicity scores: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct character n-grams (3 to 5 characters, lower case) of a whole text,
hashed to 2^20 bins. A bin's scale is the log ratio of its smoothed document counts in toxic
and other training texts. Bins whose counts differ significantly between the classes are kept
(at most MOST_BINS, by log likelihood ratio) and weighted by a ridge logistic regression on the
scaled features. Labels are learnt from a bounded sample of labelled rows (`sample_rows`, the
smallest hashes of doc_id); every text is scored.

Nulls: a null text scores as an empty one; a null doc_id is scored, never learnt from. Labelled
rows without a document or without a label are ignored; several labels of one document count
as toxic if one is. With no labels at all, or one class only, every score is the share of toxic
labels (0 without labels). Repeated rows are scored each. Columns of the input named like an
output column are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from trackmill.llm.scratch import Scratch, free_name

BITS = 20
SIZES = (3, 4, 5)
MOST_BINS = 8192
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
HELD_OUT = 2
BLOCK_CHARS = 1 << 18
SIGNIFICANT = 10.83  # chi-squared with one degree of freedom, p = 0.001


@dataclass
class Model:
    prior: float
    bias: float = 0.0
    bins: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def constant(self) -> bool:
        return not len(self.bins)


def held_out(doc_id="doc_id"):
    """True for documents whose labels are kept for testing; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == HELD_OUT, F.lit(False))


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows first..last-1, their characters as numbers, and where each row's begin."""
    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    ends = np.concatenate([[0], np.cumsum(pc.utf8_length(lower).to_numpy(zero_copy_only=False))]).astype(np.int64)
    first, n = 0, len(lower)
    while first < n:
        last = min(n, max(first + 1, int(np.searchsorted(ends, ends[first] + BLOCK_CHARS, "right")) - 1))
        joined = "".join(lower.slice(first, last - first).to_pylist())
        yield first, last, np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32), ends[first : last + 1] - ends[first]
        first = last


def _grams(codes: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bin) pairs, of wanted bins only if given."""
    found = []
    h = codes
    for size in range(2, max(SIZES) + 1):
        if len(codes) < size:
            break
        h = h[:-1] * np.uint32(0x01000193) + codes[size - 1 :]
        if size not in SIZES:
            continue
        bins = ((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1 + 2 * size)) >> np.uint32(32 - BITS)
        at = np.flatnonzero(wanted[bins]) if wanted is not None else np.arange(len(bins))
        row = np.searchsorted(offsets, at, "right") - 1
        whole = at + size <= offsets[row + 1]
        found.append((row[whole] << BITS) | bins[at[whole]].astype(np.int64))
    keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return keys >> BITS, keys & ((1 << BITS) - 1)


def _count(batches):
    """Document counts of each bin in each class, added up within the task; bin -1 counts the documents."""
    counts, rows = np.zeros((2, 1 << BITS), dtype=np.int32), [0, 0]
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        for first, last, codes, offsets in _blocks(batch.column("text")):
            row, bins = _grams(codes, offsets, None)
            for label in (0, 1):
                counts[label] += np.bincount(bins[toxic[first:last][row] == label], minlength=1 << BITS).astype(np.int32)
        for label in (0, 1):
            rows[label] += int((toxic == label).sum())
    seen = np.flatnonzero(counts.any(axis=0))
    columns = [np.concatenate([[-1], seen]), np.concatenate([[rows[0]], counts[0][seen]]), np.concatenate([[rows[1]], counts[1][seen]])]
    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["bin", "n0", "n1"])


def _features(bins: np.ndarray):
    """Per batch of training documents: labels, features per document, and the features' places in bins."""

    def run(batches):
        place = np.full(1 << BITS, -1, dtype=np.int32)
        place[bins] = np.arange(len(bins), dtype=np.int32)
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int8)
            for first, last, codes, offsets in _blocks(batch.column("text")):
                row, found = _grams(codes, offsets, place >= 0)
                sizes = np.bincount(row, minlength=last - first).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.tobytes()], pa.binary()) for x in (toxic[first:last], sizes, place[found])], names=["toxic", "sizes", "places"]
                )

    return run


def _fit(labels: np.ndarray, sizes: np.ndarray, places: np.ndarray, scale: np.ndarray, steps: int = 300) -> tuple[float, np.ndarray]:
    """Ridge logistic regression on the scaled features by accelerated gradient steps."""
    rows = np.repeat(np.arange(len(labels)), sizes)
    values = scale[places]
    w, bias = np.zeros(len(scale)), math.log(labels.mean() / (1 - labels.mean()))
    ridge = 1.0 / len(labels)
    norm = np.full(len(scale), 1.0)
    for _ in range(12):  # the largest eigenvalue of the features' second moment bounds the curvature
        z = np.bincount(rows, weights=values * norm[places], minlength=len(labels))
        norm = np.bincount(places, weights=values * z[rows], minlength=len(scale))
        top = float(np.linalg.norm(norm))
        norm /= max(top, 1e-12)
    rate = 1.0 / (0.25 * (top * 1.1 / len(labels) + 1) + ridge)
    ahead, ahead_bias, momentum = w.copy(), bias, 1.0
    for _ in range(steps):
        z = np.bincount(rows, weights=values * ahead[places], minlength=len(labels)) + ahead_bias
        gap = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(labels)
        w_next = ahead - rate * (np.bincount(places, weights=values * gap[rows], minlength=len(scale)) + ridge * ahead)
        bias_next = ahead_bias - rate * gap.sum()
        after = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        pull = (momentum - 1) / after
        ahead, ahead_bias = w_next + pull * (w_next - w), bias_next + pull * (bias_next - bias)
        w, bias, momentum = w_next, bias_next, after
    return bias, w * scale


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from labelled documents that are not held out, at most sample_rows of them."""
    sample = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")
    scratch = Scratch(docs.sparkSession)
    counts = rows.mapInArrow(_count, "bin long, n0 long, n1 long").groupBy("bin").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts = scratch.save("counts", counts)
    total = counts.filter("bin = -1").collect()
    n0, n1 = (total[0]["n0"], total[0]["n1"]) if total else (0, 0)
    if not n0 or not n1:
        return Model(prior=n1 / (n0 + n1) if n0 + n1 else 0.0)
    p = n1 / (n0 + n1)
    both = F.col("n0") + F.col("n1")
    part = lambda n, q: F.when(n > 0, n * F.log(n / (both * F.lit(q)))).otherwise(F.lit(0.0))
    ratio = F.log(((F.col("n1") + 1) / F.lit(n1 + 2)) / ((F.col("n0") + 1) / F.lit(n0 + 2)))
    best = (
        counts.filter("bin >= 0").select("bin", ratio.alias("ratio"), (2 * (part(F.col("n0"), 1 - p) + part(F.col("n1"), p))).alias("gain"))
        .filter(F.col("gain") >= SIGNIFICANT).orderBy(F.desc("gain"), "bin").limit(MOST_BINS).collect()
    )
    scratch.drop("counts")
    if not best:
        return Model(prior=p)
    bins, scale = np.array([r["bin"] for r in best]), np.array([r["ratio"] for r in best])
    parts = rows.mapInArrow(_features(bins), "toxic binary, sizes binary, places binary").collect()
    join = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in parts])
    bias, weights = _fit(join("toxic", np.int8).astype(float), join("sizes", np.int32), join("places", np.int32), scale)
    return Model(p, bias, bins, weights)


def _scores(model: Model, texts: pa.Array) -> np.ndarray:
    if model.constant():
        return np.full(len(texts), model.prior)
    weight = np.zeros(1 << BITS)
    weight[model.bins] = model.weights
    wanted = np.zeros(1 << BITS, dtype=bool)
    wanted[model.bins] = True
    out = np.zeros(len(texts))
    for first, last, codes, offsets in _blocks(texts):
        row, bins = _grams(codes, offsets, wanted)
        out[first:last] = np.bincount(row, weights=weight[bins], minlength=last - first)
    return 1 / (1 + np.exp(-np.clip(out + model.bias, -500, 500)))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with a score (0 to 1, higher: more likely toxic) and a prediction (1 from threshold on)."""
    kept = [c for c in docs.columns if c.lower() not in names]
    docs = docs.select(*(F.col(f"`{c}`") for c in kept))
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])

    def run(batches):
        for batch in batches:
            p = _scores(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*kept, *names])

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = train(docs, labels, sample_rows)
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs without those predicted toxic, in the columns of docs."""
    model = train(docs, labels, sample_rows)
    names = free_name(docs, "toxic_score"), free_name(docs, "toxic_predicted")
    return score(docs, model, names=names).filter(F.col(names[1]) == 0).select(*(F.col(f"`{c}`") for c in docs.columns))
