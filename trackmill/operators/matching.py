"""One-to-one greedy matching of detected events with true ones.

Detections in order of time each take the nearest free truth within the tolerance, the earlier one
of two. A detection depends on all before it, but only through the truths near it that they took:

* blocks of about BLOCK_ROWS rows and at least twice the tolerance are cut along each key, and a
  truth near an edge stands in both blocks. All that a block hears from the one before is how many
  copies of those shared truths are taken, and all it passes on is the same for its other edge.
* The more truths are taken before a block, the more are taken after it. So two runs, one with all
  shared truths free and one with all taken, bound what the block passes on, whatever happened
  before. Mostly both agree, and the next block's input is known.
* Where they differ in a few copies, the next block tabulates output by input, and tables are
  composed in groups of GROUP, level by level. Where the possible inputs are more than STATES,
  both blocks are handled one after the other in one stream, which holds one block at a time.

The number of jobs depends on the logarithm of the longest row of uncertain blocks only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmill.ordered import BLK, time_block
from trackmill.session import cut_lineage

BLOCK_ROWS = 4096
STATES = 64
GROUP = 64
TRUTH, DETECTION = 1, 2
ROW = "blk bigint, kind int, t_ms bigint, n bigint, early boolean, late boolean"


def greedy(dets: Sequence[tuple[int, int]], truths: Sequence[tuple[int, int]], taken: dict[int, int], tol: int) -> list[tuple[int, int | None, int]]:
    """(detection, truth or None, copies) of ascending (time, copies) lists, some copies of truths being taken.

    Free truths before the detection form a stack, and of those after it the first free one is nearest.
    """
    free = [n - taken.get(t, 0) for t, n in truths]
    stack, passed, ahead, out = [], 0, 0, []
    for d, n in dets:
        while passed < len(truths) and truths[passed][0] <= d:
            stack.append(passed)
            passed += 1
        ahead = max(ahead, passed)
        while n:
            while stack and not free[stack[-1]]:
                stack.pop()
            while ahead < len(truths) and not free[ahead]:
                ahead += 1
            before = d - truths[stack[-1]][0] if stack else tol + 1
            after = truths[ahead][0] - d if ahead < len(truths) else tol + 1
            if min(before, after) > tol:
                out.append((d, None, n))
                break
            i = stack[-1] if before <= after else ahead
            k = min(n, free[i])
            free[i] -= k
            n -= k
            out.append((d, truths[i][0], k))
    return out


class Block:
    """The rows of one block: detections, truths, and the truths shared with the block before (early) and after (late)."""

    def __init__(self, rows: list[tuple]):
        self.dets = [(t, n) for _, kind, t, n, _, _ in rows if kind == DETECTION]
        self.truths = [(t, n) for _, kind, t, n, _, _ in rows if kind == TRUTH]
        self.early = {t: n for _, kind, t, n, early, _ in rows if kind == TRUTH and early}
        self.late = [t for _, kind, t, _, _, late in rows if kind == TRUTH and late]

    def run(self, taken: dict[int, int], tol: int) -> tuple[list[tuple], dict[int, int]]:
        """The pairs, and what is taken of the truths shared with the next block."""
        pairs = greedy(self.dets, self.truths, taken, tol)
        used: dict[int, int] = {}
        for _, g, n in pairs:
            if g is not None:
                used[g] = used.get(g, 0) + n
        return pairs, {t: used[t] for t in self.late if t in used}

    def left_over(self, pairs: list[tuple], taken: dict[int, int]) -> Iterator[tuple]:
        """Copies that nobody took of the truths that no later block sees."""
        used = dict(taken)
        for _, g, n in pairs:
            if g is not None:
                used[g] = used.get(g, 0) + n
        late = set(self.late)
        return ((None, t, n - used.get(t, 0)) for t, n in self.truths if t not in late and n > used.get(t, 0))


def _blocks(batches: Iterator[pa.RecordBatch], owner: list[str]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """(values of the owner columns, iterator of (block number, Block)); rows come sorted."""
    names = [c.split()[0] for c in ROW.split(", ")]

    def rows():
        for batch in batches:
            own = zip(*(batch.column(c).to_pylist() for c in owner), strict=True)
            yield from zip(own, zip(*(batch.column(c).to_pylist() for c in names), strict=True), strict=True)

    for key, group in groupby(rows(), key=lambda r: r[0]):
        yield key, ((blk, Block([r for _, r in part])) for blk, part in groupby(group, key=lambda r: r[1][0]))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _state(edge: list[dict], number: int) -> dict[int, int]:
    """What is taken in the numbered state of an edge: copies surely taken, and a digit of the number of the unsure ones."""
    taken = {}
    for x in edge:
        number, more = divmod(number, x["unsure"] + 1)
        taken[x["t"]] = x["sure"] + more
    return taken


def _number(edge: list[dict], taken: dict[int, int]) -> int:
    number, step = 0, 1
    for x in edge:
        number += step * (taken.get(x["t"], 0) - x["sure"])
        step *= x["unsure"] + 1
    return number


EDGE = "array<struct<t:bigint,sure:bigint,unsure:bigint>>"


def place(detected: DataFrame, truth: DataFrame, tol: int, keys: list[str], rows: int) -> DataFrame:
    """Rows in their blocks: keys and the columns of ROW. Equal times of one side are one row of n copies."""
    width = max(2 * tol, 1)
    both = detected.select(*keys, "t_ms", F.lit(DETECTION).alias("kind")).unionByName(truth.select(*keys, "t_ms", F.lit(TRUTH).alias("kind")))
    tallied = cut_lineage(both.groupBy(*keys, "t_ms", "kind").agg(F.count("*").alias("n")).withColumn("cell", time_block("t_ms", width)))
    cells = tallied.groupBy(*keys, "cell").agg(F.count("*").alias("_c"))
    along = Window.partitionBy(*keys).orderBy("cell")
    cells = cells.withColumn("_raw", F.floor((F.sum("_c").over(along) - F.col("_c")) / rows))
    cells = cells.withColumn("_new", F.coalesce((F.lag("_raw").over(along) != F.col("_raw")).cast("bigint"), F.lit(0)))
    cells = cells.withColumn(BLK, F.sum("_new").over(along))  # numbered without gaps
    beside = lambda f, step: F.when(f("cell").over(along) == F.col("cell") + step, f(BLK).over(along))
    cells = cells.select(*keys, "cell", BLK, beside(F.lag, -1).alias("_prev"), beside(F.lead, 1).alias("_next"))
    d = tallied.join(cells, [*keys, "cell"])
    t, home = F.col("t_ms"), F.col(BLK)
    at = F.col("kind") == TRUTH
    # a truth also stands in the block beside its own if a detection there may reach it
    back = at & (time_block(t - tol, width) < F.col("cell")) & (F.col("_prev") < home)
    on = at & (time_block(t + tol, width) > F.col("cell")) & (F.col("_next") > home)
    targets = F.array_compact(F.array(F.when(back, F.col("_prev")), home, F.when(on, F.col("_next"))))
    d = d.select(*keys, "kind", "t_ms", "n", targets.alias("_all"), F.explode(targets).alias("blk"))
    return d.select(*keys, "blk", "kind", "t_ms", "n", (F.array_min("_all") < F.col("blk")).alias("early"), (F.array_max("_all") > F.col("blk")).alias("late"))


def bounds(placed: DataFrame, keys: list[str], tol: int) -> DataFrame:
    """Per block what it passes on in any case and what it may: keys, blk, edge."""
    schema = placed.select(*keys).schema

    def run(batches):
        def rows():
            for key, blocks in _blocks(batches, keys):
                for blk, b in blocks:
                    _, least = b.run({}, tol)
                    _, most = b.run(b.early, tol) if b.early else (None, least)
                    yield *key, blk, [{"t": t, "sure": least.get(t, 0), "unsure": most.get(t, 0) - least.get(t, 0)} for t in sorted(most)]

        kinds = [pa.field(c, _arrow(schema[c].dataType)) for c in keys]
        edge = pa.list_(pa.struct([(c, pa.int64()) for c in ("t", "sure", "unsure")]))
        yield from _batches(rows(), pa.schema([*kinds, pa.field("blk", pa.int64()), pa.field("edge", edge)]))

    dealt = placed.repartition(*keys, "blk").sortWithinPartitions(*keys, "blk", "t_ms", "kind")
    return dealt.mapInArrow(run, f"{_ddl(schema)}, blk bigint, edge {EDGE}")


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def _states(edge: Column) -> Column:
    """Number of states of an edge, up to just above STATES."""
    return F.aggregate(edge, F.lit(1).cast("bigint"), lambda s, x: F.least(s * (x["unsure"] + 1), F.lit(STATES + 1).cast("bigint")))


def compose(tables: DataFrame, keys: list[str]) -> DataFrame:
    """Which state reaches each table of a chain: keys and pos of tables(keys, pos, tab), chains counted from pos 0.

    tab gives the state after for each state before; the first table of a chain gets state 0.
    GROUP tables become one of the next level until a chain is one group.
    """
    levels = [cut_lineage(tables.select(*keys, "pos", "tab"))]
    steps = lambda d: d.groupBy(*keys, F.floor(F.col("pos") / GROUP).cast("bigint").alias("up")).agg(F.sort_array(F.collect_list(F.struct("pos", "tab"))).alias("steps"))
    longest = levels[0].agg(F.coalesce(F.max("pos"), F.lit(0))).first()[0]
    while longest >= GROUP:
        whole = F.aggregate(F.slice("steps", 2, GROUP), F.get("steps", F.lit(0))["tab"], lambda s, x: F.transform(s, lambda i: F.get(x["tab"], i)))
        levels.append(cut_lineage(steps(levels[-1]).select(*keys, F.col("up").alias("pos"), whole.alias("tab"))))
        longest //= GROUP
    came = None
    for level in reversed(levels):
        d = steps(level)
        d = d.withColumn("came", F.lit(0)) if came is None else d.join(came.withColumnRenamed("pos", "up"), [*keys, "up"])
        zero = F.struct(F.col("came").alias("now"), F.array().cast("array<struct<pos:bigint,came:int>>").alias("out"))
        walked = F.aggregate("steps", zero, lambda s, x: F.struct(
            F.get(x["tab"], s["now"]).alias("now"), F.concat(s["out"], F.array(F.struct(x["pos"].alias("pos"), s["now"].alias("came")))).alias("out")))
        came = d.select(*keys, F.inline(walked["out"]))
    return came


def match_events(detected: DataFrame, truth: DataFrame, tol_ms: int, block_rows: int = BLOCK_ROWS, keys=("video_id",)) -> DataFrame:
    """One-to-one greedy matching of (keys, t_ms) rows: keys, detected_ms, truth_ms, outcome.

    Every row comes back once: matched, false_positive (no truth) or missed (no detection).
    """
    keys = list(keys)
    placed = cut_lineage(place(detected, truth, tol_ms, keys, block_rows))
    edges = cut_lineage(bounds(placed, keys, tol_ms))
    along = Window.partitionBy(*keys).orderBy("blk")
    joined = F.lag("blk").over(along) == F.col("blk") - 1
    before = F.when(joined, F.lag("edge").over(along))
    units = edges.withColumn("before", F.coalesce(before, F.array().cast(EDGE))).withColumn("states", _states(F.col("before")))
    units = units.withColumn("unit", F.sum((F.col("states") <= STATES).cast("bigint")).over(along))
    units = units.withColumn("chain", F.sum((F.col("states") == 1).cast("bigint")).over(along))
    units = cut_lineage(units)
    # one row per unit: what it may hear, what it may pass on
    heads = units.groupBy(*keys, "unit", "chain").agg(F.min_by("before", "blk").alias("before"), F.min_by("states", "blk").alias("states"), F.max_by("edge", "blk").alias("edge"))
    rows = placed.join(units.select(*keys, "blk", "unit"), [*keys, "blk"])
    unsure = heads.where("states > 1").select(*keys, "chain").distinct()
    if unsure.isEmpty():
        came = heads.select(*keys, "unit", "before", F.lit(0).alias("came"))
    else:
        open_ = heads.join(unsure, [*keys, "chain"], "left_semi")
        tables = _by_unit(rows, open_.select(*keys, "unit", "before", "edge", "states"), keys, tol_ms, "table")
        chains = Window.partitionBy(*keys, "chain").orderBy("unit")
        tables = tables.join(heads.select(*keys, "unit", "chain"), [*keys, "unit"]).withColumn("pos", (F.row_number().over(chains) - 1).cast("bigint"))
        tables = cut_lineage(tables)
        reached = compose(tables, [*keys, "chain"]).join(tables.select(*keys, "chain", "pos", "unit"), [*keys, "chain", "pos"])
        came = heads.join(reached.select(*keys, "unit", "came"), [*keys, "unit"], "left").select(*keys, "unit", "before", F.coalesce("came", F.lit(0)).alias("came"))
    done = _by_unit(rows, came.withColumn("edge", F.array().cast(EDGE)).withColumn("states", F.lit(1).cast("bigint")), keys, tol_ms, "pairs")
    what = F.when(F.col("g").isNull(), "false_positive").when(F.col("d").isNull(), "missed").otherwise("matched")
    each = done.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")))
    return each.select(*keys, F.col("d").alias("detected_ms"), F.col("g").alias("truth_ms"), what.alias("outcome"))


def _by_unit(rows: DataFrame, heads: DataFrame, keys: list[str], tol: int, what: str) -> DataFrame:
    """Run units block by block: from each possible state to a table of states, or from the state that came to pairs.

    A unit's head travels as the first row of its stream.
    """
    owner = [*keys, "unit"]
    schema = rows.select(*owner).schema
    came = F.col("came") if "came" in heads.columns else F.lit(0)
    head = F.struct("before", "edge", "states", came.cast("int").alias("came"))
    first = heads.select(*owner, F.lit(-1).cast("bigint").alias("blk"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("t_ms"),
                         F.lit(0).cast("bigint").alias("n"), F.lit(False).alias("early"), F.lit(False).alias("late"), head.alias("head"))
    stream = rows.join(heads.select(*owner), owner, "left_semi").select(*owner, "blk", "kind", "t_ms", "n", "early", "late", F.lit(None).cast(first.schema["head"].dataType).alias("head"))
    dealt = stream.unionByName(first).repartition(*owner).sortWithinPartitions(*owner, "blk", "t_ms", "kind")
    pairs = what == "pairs"

    def run(batches):
        seen = {}

        def watched():
            for batch in batches:
                for i, kind in enumerate(batch.column("kind").to_pylist()):
                    if kind == 0:
                        seen[tuple(batch.column(c)[i].as_py() for c in owner)] = batch.column("head")[i].as_py()
                yield batch

        def rows_of():
            for key, blocks in _blocks(watched(), owner):
                next(blocks)  # the head's own place
                head = seen.pop(key)
                if pairs:
                    taken = _state(head["before"], head["came"])
                    for _, b in blocks:
                        found, later = b.run(taken, tol)
                        for d, g, n in (*found, *b.left_over(found, taken)):
                            yield *key, d, g, n
                        taken = later
                else:
                    taken = [_state(head["before"], i) for i in range(head["states"])]
                    for _, b in blocks:
                        known: dict[tuple, dict[int, int]] = {}
                        for i, x in enumerate(taken):
                            mark = tuple(sorted(x.items()))
                            if mark not in known:
                                known[mark] = b.run(x, tol)[1]
                            taken[i] = known[mark]
                    yield *key, [_number(head["edge"], x) for x in taken]

        kinds = [pa.field(c, _arrow(schema[c].dataType)) for c in owner]
        fields = [pa.field(c, pa.int64()) for c in ("d", "g", "n")] if pairs else [pa.field("tab", pa.list_(pa.int32()))]
        yield from _batches(rows_of(), pa.schema([*kinds, *fields]))

    return dealt.mapInArrow(run, f"{_ddl(schema)}, {'d bigint, g bigint, n bigint' if pairs else 'tab array<int>'}")
