"""Approximate nearest neighbours: a forest of random-projection trees with a shared queue.

Every tree halves a bounded sample of the vectors (`sample_rows`, by hash of the id) again and
again at the median of a random projection, down to `leaf_rows` sampled vectors. All rows are
routed to a leaf of every tree. A query descends all trees through one priority queue, ordered by
the largest distance it has to be on the wrong side of a split, and visits leaves until they
are expected to hold `share` of the rows (at least `least_rows` rows). The visited leaves'
rows are then ranked exactly, by Euclidean distance in double precision.

The share decides the recall. Vectors without cluster structure need a large one: on 10,256
nearly isotropic vectors of 64 dimensions, 0.2 of the rows gave a recall of 0.65, 0.39 gave 0.86
and 0.59 gave 0.96; the default is set for such data. Clustered data do with less.

Leaves are cut into chunks of CHUNK_ROWS rows and queries into chunks of CHUNK_QUERIES, so a
common vector, which no split can part, still makes bounded tasks, and a chunk keeps only each
query's k nearest.

Vectors that are null, all zero, of another length than most, or hold null or non-finite
components take no part, nor do rows with a null id. A query is never its own neighbour; rows
with its id are its own. Of several rows with one id the nearest counts. Equal distances are
ordered by id. An empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmill.llm.arrays import mix

TREES = 8
SAMPLE_ROWS = 20_000
LEAF_ROWS = 64
SHARE = 0.62
LEAST_ROWS = 2_000
CHUNK_ROWS = 4_096
CHUNK_QUERIES = 1_024
GROUP_ROWS = 32_768


class Tree:
    """Splits in an array: node i parts at planes[i] . x <= at[i] into left[i] and right[i]; leaves are -1, -2, ..."""

    def __init__(self, sample: np.ndarray, leaf_rows: int, seed: int):
        rng = np.random.default_rng(seed)
        planes, at, sides = [], [], []
        self.leaves = 0
        todo = [(np.arange(len(sample)), None)]
        while todo:
            rows, parent = todo.pop()
            plane = cut = None
            if len(rows) > leaf_rows:
                for _ in range(3):  # equal vectors cannot be parted
                    plane = rng.standard_normal(sample.shape[1])
                    plane /= np.linalg.norm(plane)
                    p = sample[rows] @ plane
                    cut = float(np.median(p))
                    if (p <= cut).any() and (p > cut).any():
                        break
                    cut = None
            if cut is None:
                node = -1 - self.leaves
                self.leaves += 1
            else:
                node = len(planes)
                planes.append(plane)
                at.append(cut)
                sides.append([0, 0])
                todo += [(rows[p > cut], (node, 1)), (rows[p <= cut], (node, 0))]
            if parent is not None:
                sides[parent[0]][parent[1]] = node
        self.planes = np.array(planes).reshape(len(planes), sample.shape[1])
        self.at = np.array(at)
        self.sides = np.array(sides, dtype=np.int64).reshape(len(planes), 2)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64) if len(self.planes) else np.full(len(x), -1)
        while (inner := np.flatnonzero(node >= 0)).size:
            n = node[inner]
            side = (np.einsum("ij,ij->i", x[inner], self.planes[n]) > self.at[n]).astype(int)
            node[inner] = self.sides[n, side]
        return -1 - node


def visited(trees: list[Tree], sizes: list[np.ndarray], rows: int, x: np.ndarray, share: float) -> list[tuple[int, int]]:
    """Leaves (tree, leaf) of a query, most promising first, until they should hold `share` of the rows."""
    margins = [t.planes @ x - t.at for t in trees]
    queue = [(0.0, t, 0 if len(tree.planes) else -1) for t, tree in enumerate(trees)]
    out, seen = [], np.zeros(len(trees))
    while queue:
        far, t, node = heapq.heappop(queue)
        while node >= 0:
            margin, sides = margins[t][node], trees[t].sides[node]
            heapq.heappush(queue, (max(far, abs(margin)), t, int(sides[0 if margin > 0 else 1])))
            node = int(sides[1 if margin > 0 else 0])
        leaf = -1 - node
        out.append((t, leaf))
        seen[t] += sizes[t][leaf] / rows
        if 1 - np.prod(1 - np.minimum(seen, 1)) >= share:
            break
    return out


def usable(vector: str = "embedding") -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(vector).isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)


def _matrix(lists) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 1)


def _cells(trees: list[Tree], chunks: list[np.ndarray]):
    """The leaf of every row in every tree, and its chunk of the leaf."""

    def run(batches):
        for batch in batches:
            ids, x = batch.column("id"), _matrix(batch.column("v"))
            packed = pa.array([r.tobytes() for r in x], pa.binary())
            for t, tree in enumerate(trees):
                leaf = tree.leaf(x.astype(np.float64))
                chunk = (mix(ids.to_numpy().view(np.uint64)) % chunks[t][leaf].astype(np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t)), pa.array(leaf), pa.array(chunk), ids, packed], names=["tree", "leaf", "chunk", "id", "v"])

    return run


def _nearest(k: int, kind: np.dtype):
    """A chunk of leaves' rows and the queries that visit them: each query's k nearest."""

    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        if len(rows) and len(queries):
            by_cell = dict(list(queries.groupby(["tree", "leaf"])))
            for cell, some in rows.groupby(["tree", "leaf"]):
                asked = by_cell.get(cell)
                if asked is None:
                    continue
                x = np.frombuffer(b"".join(some["v"]), kind).reshape(len(some), -1).astype(np.float64)
                q = np.frombuffer(b"".join(asked["v"]), kind).reshape(len(asked), -1).astype(np.float64)
                ids = some["id"].to_numpy()
                rough = np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * q @ x.T, 0)
                slack = 1e-9 * ((q * q).sum(1) + (x * x).sum(1).max())
                for i, query in enumerate(asked["id"].tolist()):
                    near = rough[i]
                    if len(near) > k + 1:  # the query's own row may be among them
                        near_at = np.flatnonzero(near <= np.partition(near, k)[k] + slack[i])
                    else:
                        near_at = np.arange(len(near))
                    near_at = near_at[ids[near_at] != query]
                    d = np.sqrt(((x[near_at] - q[i]) ** 2).sum(1))
                    found.setdefault(query, []).append((ids[near_at], d))
        out = []
        for query, parts in found.items():
            ids, d = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.lexsort((ids, d))
            ids, d = ids[order], d[order]
            first = np.sort(np.unique(ids, return_index=True)[1])[:k]  # a row may be in a leaf of several trees
            out.append(pd.DataFrame({"query_id": query, "vec_id": ids[first], "score": d[first]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, trees: int = TREES, share: float = SHARE, sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS, least_rows: int = LEAST_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query.

    vectors and queries: id and v (an array of floats). queries may be any number of rows.
    """
    sizes = vectors.filter(F.col("id").isNotNull() & usable("v")).groupBy(F.size("v").alias("d")).agg(F.count("*").alias("c"))
    most = sizes.orderBy(F.desc("c"), F.desc("d")).first()
    spark = vectors.sparkSession
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = int(most["c"])
    fit = lambda df: df.filter(F.col("id").isNotNull() & usable("v") & (F.size("v") == most["d"])).select(F.col("id").cast("long").alias("id"), "v")
    vectors, queries = fit(vectors), fit(queries)
    kind = np.dtype(np.float32 if vectors.schema["v"].dataType.elementType.typeName() == "float" else np.float64)
    if kind == np.float64:
        vectors, queries = (df.withColumn("v", F.col("v").cast("array<double>")) for df in (vectors, queries))
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(sample_rows).toArrow()["v"].combine_chunks()
    sample = _matrix(sample).astype(np.float64)
    forest = [Tree(sample, leaf_rows, seed) for seed in range(trees)]
    counts = [np.zeros(t.leaves) for t in forest]
    for r in vectors.select("id", "v").mapInArrow(_count(forest), "tree long, leaf long, c long").groupBy("tree", "leaf").agg(F.sum("c").alias("c")).collect():
        counts[r["tree"]][r["leaf"]] = r["c"]  # at most trees * sample_rows / leaf_rows * 2 rows
    chunks = [np.maximum(1, -(-c.astype(np.int64) // CHUNK_ROWS)) for c in counts]
    cells = vectors.mapInArrow(_cells(forest, chunks), "tree long, leaf long, chunk long, id long, v binary")
    share = max(share, min(1.0, least_rows / rows))
    groups = max(1, -(-rows * trees // GROUP_ROWS))

    def search(batches):
        for batch in batches:
            x = _matrix(batch.column("v"))
            for i, query in enumerate(batch.column("id").to_pylist()):
                leaves = visited(forest, counts, rows, x[i].astype(np.float64), share)
                parts = [int(chunks[t][leaf]) for t, leaf in leaves]
                t, leaf = (np.repeat([v[j] for v in leaves], parts) for j in (0, 1))
                chunk = np.concatenate([np.arange(c) for c in parts])
                packed = pa.array([x[i].tobytes()] * len(t), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(leaf), pa.array(chunk), pa.array(np.full(len(t), query)), packed], names=["tree", "leaf", "chunk", "id", "v"])

    asked = queries.repartition(F.col("id")).mapInArrow(search, "tree long, leaf long, chunk long, id long, v binary")
    parts = max(1, -(-queries.count() // CHUNK_QUERIES))
    group = F.pmod(F.xxhash64("tree", "leaf", "chunk"), F.lit(groups)).alias("g")
    cells = cells.select(group, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), "tree", "leaf", "id", "v")
    asked = asked.select(group, F.pmod(F.xxhash64("id"), F.lit(parts)).cast("long").alias("part"), "tree", "leaf", "id", "v")
    found = cells.groupBy("g", "part").cogroup(asked.groupBy("g", "part")).applyInPandas(_nearest(k, kind), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _count(trees: list[Tree]):
    def run(batches):
        held = [np.zeros(t.leaves, dtype=np.int64) for t in trees]
        for batch in batches:
            x = _matrix(batch.column("v")).astype(np.float64)
            for t, tree in enumerate(trees):
                held[t] += np.bincount(tree.leaf(x), minlength=tree.leaves)
        for t, c in enumerate(held):
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t)), pa.array(at), pa.array(c[at])], names=["tree", "leaf", "c"])

    return run
