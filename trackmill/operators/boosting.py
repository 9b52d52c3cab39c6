"""Gradient-boosted trees for many folds at once.

A recording's clips are scored by a model that never saw it, so there are as many models as
recordings. They differ only in the rows left out, and Spark shares the work accordingly:

* features are cut into at most BINS bins at their quantiles; rows equal in bins, label and fold
  become one entry with a weight, so what is fitted no longer grows with copies;
* the sums over all entries by bins alone ("cells") go to every task; tasks take folds in blocks, each
  fold with its own entries, take those away from the sums, and grow the block's trees together;
* `fit` gives one row of trees per fold, and `predict` scores rows by the trees of their fold with
  built-in functions; `held_out` scores each fold's distinct bins where its model is grown.

One task needs all cells, never all entries: two features have at most BINS ** 2 cells, however many
rows and folds there are. MOST_ENTRIES bounds them: with more cells than that the fit uses a sample of
them by hash (scoring never does). The cells sent to the tasks take at most MOST_ENTRIES * (features + 16) bytes.

The loss is the log-loss, splits maximise the Friedman gain of the residuals, leaves take one
Newton step. With a sample rate below 1 every tree sees a binomial part of the weight that each cell
and label has without the fold, by uniform numbers that depend on the tree and the cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmill.session import cut_lineage

BINS = 64
MOST_ENTRIES = 2_000_000
KEPT_DRAWS = 5_000_000
KEPT_BYTES = 64 << 20
NO_CUT = np.iinfo(np.int64).max
BLOCK_CELLS = 300_000  # numbers of one array of a block, of which there are four
CACHED = 32_000  # numbers of one array of a part of a block: some such arrays fit a core's cache
TREES = "fold string, base double, trees array<struct<f:array<int>,c:array<double>,v:array<double>>>"


@dataclass
class Settings:
    trees: int
    depth: int
    rate: float
    sample: float = 1.0


@dataclass
class Model:
    """Trees by fold; fold is null in the row of the model that leaves nothing out."""

    rows: DataFrame
    features: list[str]
    depth: int


class Cells:
    """Distinct bins in ascending order, with the weight of either label.

    Sums run over a full grid of bins, with empty cells between, if that is not much larger than the cells
    themselves: what lies behind some splits is a box of it. Else cells are put in the order of each feature's bins.
    """

    def __init__(self, table: pa.Table, n_features: int, n_cuts: list[int]):
        bins, keys = _keys(table, n_features)
        order = np.argsort(keys)
        self.keys, bins = keys[order], bins[order]
        self.weight = np.stack([table.column(c).to_numpy()[order] for c in ("neg", "pos")])
        self.held, place = {}, {}  # by feature: its bins, and the place of each cell's bin among them
        for j in range(n_features):
            if n_cuts[j] and len(bins):
                held, at = np.unique(bins[:, j], return_inverse=True)
                if len(held) > 1:
                    self.held[j], place[j] = held.astype(np.int64), at.ravel()
        sides = [len(x) for x in self.held.values()]
        self.grid = tuple(sides) if sides and math.prod(sides) <= 2 * len(self) else None
        self.size, self.spot = len(self), np.arange(len(self))  # of what is summed up; a cell's place in it
        if self.grid:
            self.size, self.spot = math.prod(sides), np.ravel_multi_index(tuple(place.values()), self.grid)
            place = dict(zip(self.held, np.unravel_index(np.arange(self.size), self.grid), strict=True))
        self.place = place
        self.drawn, self.draws = {}, None
        self.made, self.bytes = {}, 0

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, table: pa.Table, n_features: int) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row, and whether there is one (a bounded fit keeps only some)."""
        keys = _keys(table, n_features)[1]
        at = np.searchsorted(self.keys, keys).clip(max=max(len(self) - 1, 0))
        return at, self.keys[at] == keys if len(self) else np.zeros(len(keys), bool)

    def spread(self, weight: np.ndarray) -> np.ndarray:
        """Weights of the cells where sums are made, and those of both labels."""
        out = np.zeros((3, self.size))
        out[:2, self.spot] = weight
        out[2] = out[0] + out[1]
        return out

    def draw(self, s: Settings, seed: int, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The uniform numbers of a tree, the drawn weights and these spread; kept for the next block while they are few."""
        if t in self.drawn:
            return self.drawn[t]
        uniform = np.random.default_rng((seed, t)).random(self.weight.shape)
        drawn = self.draws(self.weight, uniform)
        found = uniform, drawn, self.spread(drawn)
        if self.weight.size * s.trees <= KEPT_DRAWS:
            self.drawn[t] = found
        return found

    def keep(self, key: tuple, make):
        """What make() gives, kept for the next block while all that is kept is small."""
        if key not in self.made:
            found = make()
            size = sum(x.nbytes for x in (found if isinstance(found, tuple) else (found,)) if x is not None)
            if self.bytes + size > KEPT_BYTES:
                self.made, self.bytes = {}, 0
            self.made[key], self.bytes = found, self.bytes + size
        return self.made[key]

    def box(self, path: tuple) -> tuple[slice, ...]:
        """The part of the grid behind a path of (feature, places up to the cut, upper side) from the root."""
        ends = {j: (0, len(x)) for j, x in self.held.items()}
        for f, c, high in path:
            low, top = ends[f]
            ends[f] = (max(low, c), top) if high else (low, min(top, c))
        return (slice(None), *[slice(low, top) for low, top in ends.values()])

    def part(self, path: tuple) -> np.ndarray:
        """The cells, ascending, behind a path."""
        def make():
            if not path:
                return np.arange(len(self))
            at, (f, c, high) = self.part(path[:-1]), path[-1]
            return at[(self.place[f][at] >= c) == high]
        return self.keep(("part", path), make)

    def count(self, path: tuple) -> int:
        """How many cells lie behind a path."""
        return math.prod(max(0, x.stop - x.start) for x in self.box(path)[1:]) if self.grid else len(self.part(path))

    def order(self, path: tuple, j: int) -> tuple:
        """A part's cells by their bin of a feature (None: as they lie), where each bin starts, and the bins' places."""
        def make():
            at = self.part(path)
            by = np.argsort(self.place[j][at], kind="stable")
            places, start = np.unique(self.place[j][at][by], return_index=True)
            return None if len(at) == len(self) and (by[1:] > by[:-1]).all() else at[by], start, places
        return self.keep(("order", path, j), make)

    def by_bin(self, x: np.ndarray, path: tuple, j: int) -> np.ndarray:
        """Per model (a row of x) the sum over a part by bin of a feature."""
        out = np.zeros((len(x), len(self.held[j])))
        if self.grid:
            box, axis = self.box(path), 1 + list(self.held).index(j)
            out[:, box[axis]] = np.einsum(x.reshape(-1, *self.grid)[box], list(range(len(box))), [0, axis])
            return out
        by, start, places = self.order(path, j)
        if len(start):
            out[:, places] = np.add.reduceat(x if by is None else x.take(by, axis=1, mode="clip"), start, axis=1)
        return out

    def total(self, x: np.ndarray, path: tuple) -> np.ndarray:
        """Per model the sum over a part."""
        if self.grid:
            return np.einsum(x.reshape(-1, *self.grid)[self.box(path)], list(range(1 + len(self.grid))), [0])
        return (x.take(self.part(path), axis=1, mode="clip") if path else x).sum(axis=1)

    def leaves(self, parts: tuple) -> np.ndarray:
        """Which of some parts (paths, or None for no cells) each cell lies in."""
        def make():
            leaf = np.zeros(self.grid or self.size, np.intp)
            for i, path in enumerate(parts):
                if path is not None:
                    leaf[self.box(path)[1:] if self.grid else self.part(path)] = i
            return leaf.ravel()
        return self.keep(("leaves", parts), make)


def _keys(table: pa.Table, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins as a matrix of bytes, and each row of it as one comparable value."""
    bins = np.stack([table.column(f"b{j}").to_numpy() for j in range(n_features)], axis=1).astype(np.uint8)
    return bins, np.ascontiguousarray(bins).view(f"S{n_features}").ravel()


class Draws:
    """Exact binomial parts of whole weights: one uniform number and the quantile function of the weight.

    What is drawn depends on the weight that is left and the cell's own number alone, so rows of the fold
    left out cannot move the draws of its model.
    """

    def __init__(self, weights: np.ndarray, rate: float):
        self.rate = rate
        self._clear()
        self.places(weights)

    def _clear(self) -> None:
        self.of, self.at = np.zeros(0, np.int64), np.zeros(0, np.int64)  # weights, ascending, and their places
        self.steps, self.first, self.low = np.zeros(0), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def places(self, weights: np.ndarray) -> np.ndarray:
        """The place of each weight's quantile function; new weights are added, and all others dropped when they are many."""
        weights = weights.astype(np.int64)
        new = np.setdiff1d(weights, self.of)
        if len(new) and len(self.steps) > KEPT_DRAWS:
            self._clear()
            new = np.unique(weights)
        if len(new):
            rate, known = self.rate, len(self.of)
            logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, int(new[-1]) + 1)))])
            steps, first, low = [self.steps], self.first.tolist(), []
            for i, n in enumerate(new.tolist(), known):
                reach = 40 + 12 * int(np.sqrt(n * rate * (1 - rate)))
                k = np.arange(max(0, int(n * rate) - reach), min(n, int(n * rate) + reach) + 1)
                mass = np.cumsum(np.exp(logs[n] - logs[k] - logs[n - k] + k * np.log(rate) + (n - k) * np.log1p(-rate)))
                steps.append(i + np.minimum(mass[:-1] / mass[-1], 1 - 1e-9))  # beyond the last step lies the largest value
                low.append(int(k[0]))
                first.append(first[-1] + len(k) - 1)
            self.steps, self.first = np.concatenate(steps), np.array(first)
            self.low = np.concatenate([self.low, np.array(low, np.int64)])
            of, at = np.concatenate([self.of, new]), np.concatenate([self.at, np.arange(known, known + len(new))])
            by = np.argsort(of)
            self.of, self.at = of[by], at[by]
        return self.at[np.searchsorted(self.of, weights)] if len(self.of) else weights

    def __call__(self, weights: np.ndarray, uniform: np.ndarray) -> np.ndarray:
        i = self.places(weights)
        return (self.low[i] + np.searchsorted(self.steps, i + uniform * (1 - 1e-9), side="right") - self.first[i]).astype(float)

    def near(self, i: np.ndarray, uniform: np.ndarray, guess: np.ndarray) -> np.ndarray:
        """The same for places i, found step by step from a guess (what a little more weight drew)."""
        x, first, last = i + uniform * (1 - 1e-9), self.first[i], self.first[i + 1]
        to = np.clip(first + guess.astype(np.int64) - self.low[i], first, last)
        todo = np.arange(len(to))
        while len(todo):  # down while the step before lies beyond
            t = to[todo]
            todo = todo[(t > first[todo]) & (self.steps[np.maximum(t - 1, 0)] > x[todo])]
            to[todo] -= 1
        todo = np.arange(len(to))
        while len(todo):
            t = to[todo]
            todo = todo[(t < last[todo]) & (self.steps[np.minimum(t, max(len(self.steps) - 1, 0))] <= x[todo])] if len(self.steps) else todo[:0]
            to[todo] += 1
        return (self.low[i] + to - first).astype(float)


def grow(cells: Cells, folds: list[str | None], own: tuple, asked: tuple, s: Settings, cuts: list[list[float]], seed: int = 0, wanted: list[int] | None = None) -> tuple:
    """Bases and trees of the models that leave out one fold each, and the scores of the rows asked for.

    own: label, model, cell and weight of the folds' training rows; asked: model and bins of the rows to score;
    wanted: the models whose trees are returned (None: all).

    The weights are those of all folds less a fold's own, so weights are summed up once for all models and a
    fold's few entries are taken away from the sums. Models mostly choose the same splits: those that share a
    tree's splits so far are worked on together, and of a node's two sides only the smaller one is summed up.
    """
    m = len(folds)
    label, model, at, weight = own
    whose, bins = asked
    if s.sample < 1:
        if cells.draws is None:
            cells.draws = Draws(cells.weight.ravel(), s.sample)
        held = cells.draws.places(cells.weight[label, at] - weight)
    taken = _summed(2 * model + label, weight, m, 2)
    neg, pos = (cells.weight.sum(axis=1) - taken).T
    share = np.where(pos + neg > 0, pos / np.maximum(pos + neg, 1), 0.5).clip(1e-6, 1 - 1e-6)
    base = np.log(share / (1 - share))
    raw = base[whose]
    odds = np.repeat(np.exp(-base)[:, None], cells.size, axis=1)  # against the label, per model and cell
    p, r, b = (np.empty_like(odds) for _ in range(3))
    step = max(1, CACHED // max(1, cells.size))
    whole, spot = cells.spread(cells.weight), cells.spot[at]
    rows, label_of = np.arange(len(whose)), [np.flatnonzero(label == y) for y in (0, 1)]
    touched, place = np.unique(model * cells.size + spot, return_inverse=True)  # a fold's cells, of either label
    left = np.zeros((2, len(touched)))
    wanted = range(m) if wanted is None else wanted
    nodes, grown, reach = 2**s.depth - 1, [[] for _ in folds], 14.0
    for t in range(s.trees):
        gone, tree = weight, None
        if s.sample < 1:
            uniform, drawn, whole = cells.draw(s, seed, t)
            mine, tree = drawn[label, at], t
            gone = mine - cells.draws.near(held, uniform[label, at], mine)
        # residual pos * (1 - p) - neg * p and bend (pos + neg) * p * (1 - p), with 1 - p = odds * p
        for i in range(0, m, step):
            po, pp, pr, pb = (x[i : i + step] for x in (odds, p, r, b))
            np.add(po, 1, out=pp)
            np.divide(1, pp, out=pp)
            np.multiply(po, whole[1], out=pr)
            np.subtract(pr, whole[0], out=pr)
            np.multiply(pr, pp, out=pr)
            np.multiply(po, pp, out=pb)
            np.multiply(pb, pp, out=pb)
            np.multiply(pb, whole[2], out=pb)
        # a fold's own cells: not subtracted later, as even roundings must not tell what was left out
        o, q = odds.ravel()[touched], p.ravel()[touched]
        left[:] = whole[:2, touched % cells.size]
        for y, k in enumerate(label_of):
            left[y, place[k]] -= gone[k]
        r.ravel()[touched] = (left[1] * o - left[0]) * q
        b.ravel()[touched] = (left[0] + left[1]) * o * q * q
        feature, cut, value = np.zeros((m, nodes), np.int64), np.full((m, nodes), NO_CUT), np.zeros((m, nodes + 1))
        _grow_tree(cells, s, whole, tree, (r, b, odds), (model, spot, gone), feature, cut, value)
        reach += np.abs(value).max(initial=0)
        if reach > 200:
            np.clip(odds, 1e-280, 1e280, out=odds)
        at_node = np.zeros(len(whose), np.int64)
        for _ in range(s.depth):
            at_node = 2 * at_node + 1 + (bins[rows, feature[whose, at_node]] > cut[whose, at_node])
        raw = raw + value[whose, at_node - nodes]
        for i in wanted:
            edges = [cuts[f][c] if c < len(cuts[f]) else float("inf") for f, c in zip(feature[i].tolist(), cut[i].tolist(), strict=True)]
            grown[i].append({"f": feature[i].tolist(), "c": edges, "v": value[i].tolist()})
    return base.tolist(), grown, raw


def _grow_tree(cells: Cells, s: Settings, whole: np.ndarray, tree: int | None, sums: tuple, own: tuple, feature: np.ndarray, cut: np.ndarray, value: np.ndarray) -> None:
    """One tree of every model: fill in its splits and leaves, and bring the odds up to date.

    whole: the weights of the tree, in which all models share; sums: residuals, bends and odds; own: model, spot and weight
    of the folds' entries, which residuals and bends are already without. Sums of whole weights are exact, so these are taken away.
    """
    r, b, odds = sums
    model, spot, gone = own
    features = list(cells.held)
    # a group shares the splits so far: its models and entries (None: all), the node of each entry, and each node's path
    # (None: no cells) and residuals by feature and bin
    groups = [(None, None, np.zeros(len(spot), np.int64), [((), [cells.by_bin(r, (), j) for j in features])])]
    for level in range(s.depth):
        first, further = 2**level - 1, []
        for rows, mine, node, parts in groups:
            g, k = len(r) if rows is None else len(rows), len(parts)
            at = spot if mine is None else spot[mine]
            whose, less = (model, gone) if mine is None else (np.searchsorted(rows, model[mine]), gone[mine])
            counts, residuals = (np.zeros((g, k, len(features), max(map(len, cells.held.values()), default=0))) for _ in range(2))
            for i, j in enumerate(features):
                side = len(cells.held[j])
                to = (whose * k + node) * side + cells.place[j][at]
                c, x = _summed(to, less, g, k, side), residuals[:, :, i, :side]
                for n, (path, held) in enumerate(parts):
                    if path is not None:
                        c[:, n] = cells.keep(("weight", tree, path, j), lambda: cells.by_bin(whole[2:], path, j)) - c[:, n]  # noqa: B023
                        x[:, n] = held[i]
                x[c <= 0] = 0  # nothing but a fold's own rows lies there
                counts[:, :, i, :side] = c
            step = max(1, CACHED // max(1, counts[0].size))
            found = [_best_splits(cells, counts[x : x + step], residuals[x : x + step]) for x in range(0, g, step)]
            f, c, low, here = (np.concatenate(x) for x in zip(*found, strict=True))
            for some in _alike(f, c):
                own_rows = some if rows is None else rows if some is None else rows[some]
                to, one = slice(None) if own_rows is None else own_rows, 0 if some is None else some[0]
                feature[to, first : first + k], cut[to, first : first + k] = f[one], c[one]
                chosen = [None if cn == NO_CUT else (int(fn), int(np.searchsorted(cells.held[fn], cn, side="right"))) for fn, cn in zip(f[one], c[one], strict=True)]
                own_mine, own_at, own_node = mine, at, node
                if some is not None:
                    member = np.zeros(g, bool)
                    member[some] = True
                    inside = np.flatnonzero(member[whose])
                    own_mine, own_at, own_node = inside if mine is None else mine[inside], at[inside], node[inside]
                high = np.zeros(len(own_at), bool)
                for n, split in enumerate(chosen):
                    if split is not None:
                        high |= (own_node == n) & (cells.place[split[0]][own_at] >= split[1])
                tops = low if some is None else low[some], here if some is None else here[some]
                below = []
                for (path, held), split in zip(parts, chosen, strict=True):
                    below += _sides(cells, r, own_rows, path, [x if some is None else x[some] for x in held], split, level + 1 < s.depth)
                further.append((own_rows, own_mine, 2 * own_node + high, below, tops))
        groups = [x[:4] for x in further]
    for rows, _, _, parts, (low, here) in further:
        g, n_leaves = len(low), len(parts)
        where = cells.leaves(tuple(path for path, _ in parts))
        bend = b if rows is None else b[rows]
        bottom = np.zeros((g, n_leaves))
        for n, (path, _) in enumerate(parts):
            if path is not None:
                bottom[:, n] = cells.total(bend, path)
        if not features:
            # all rows share their bins: no splits, one group
            here = np.where(whole[2].sum() > _summed(model, gone, g), r.sum(axis=1), 0)[:, None]
            low = here = np.pad(here, ((0, 0), (0, n_leaves // 2 - 1)))
        top = np.stack([low, here - low], axis=2).reshape(g, n_leaves)
        found = s.rate * np.where(bottom > 1e-150, top / np.where(bottom > 1e-150, bottom, 1), 0)
        value[slice(None) if rows is None else rows] = found
        factor = np.exp(-found.clip(-300, 300)).take(where, axis=1, mode="clip")
        if rows is None:
            odds *= factor
        else:
            odds[rows] *= factor


def _summed(to: np.ndarray, x: np.ndarray, *shape: int) -> np.ndarray:
    """Entries summed up by their place in an array."""
    return np.bincount(to, x, math.prod(shape)).astype(float).reshape(shape)


def _sides(cells: Cells, r: np.ndarray, rows: np.ndarray | None, path: tuple | None, sums: list, split: tuple | None, further: bool) -> list:
    """Path and sums of a node's lower and upper side; only the side of fewer cells is summed up."""
    if path is None or split is None:  # a node without a split sends all to its lower side
        return [(path, sums), (None, [])]
    low, high = (*path, (*split, False)), (*path, (*split, True))
    if not further:
        return [(low, []), (high, [])]
    small = low if cells.count(low) <= cells.count(high) else high
    few = rows is not None and 2 * len(rows) < len(r)
    of_small, x = [], None
    for j, whole in zip(cells.held, sums, strict=True):
        if j == split[0]:
            of_small.append(whole * ((np.arange(whole.shape[1]) >= split[1]) == small[-1][2]))
        else:
            x = x if x is not None else r[rows] if few else r
            found = cells.by_bin(x, small, j)
            of_small.append(found if few or rows is None else found[rows])
    of_other = [x - y for x, y in zip(sums, of_small, strict=True)]
    return [(low, of_small), (high, of_other)] if small is low else [(low, of_other), (high, of_small)]


def _alike(feature: np.ndarray, cut: np.ndarray) -> list[np.ndarray | None]:
    """The models of each choice of splits; None if all agree."""
    if (feature == feature[0]).all() and (cut == cut[0]).all():
        return [None]
    found: dict = {}
    for i in range(len(feature)):
        found.setdefault((feature[i].tobytes(), cut[i].tobytes()), []).append(i)
    return [np.array(x) for x in found.values()]


def _best_splits(cells: Cells, counts: np.ndarray, residuals: np.ndarray) -> tuple:
    """Per model and node the feature and cut of greatest gain, and the residuals up to the cut and in all.

    Sums by model, node, feature and bin; features of fewer bins end with zeros.
    """
    c, r = counts.cumsum(axis=3), residuals.cumsum(axis=3)
    shape = c.shape[:2]
    best, feature, cut = np.zeros(shape), np.zeros(shape, np.int64), np.full(shape, NO_CUT)
    here = r[:, :, 0, -1] if r.size else np.zeros(shape)
    low = here.copy()
    if not r.size:
        return feature, cut, low, here
    cl, rl, all_c = c[..., :-1], r[..., :-1], c[..., -1:]
    # the gain cl * cr / (cl + cr) * (rl / cl - rr / cr) ** 2
    both = (all_c - cl) * cl
    gain = rl * all_c
    gain -= cl * r[..., -1:]
    gain *= gain
    gain /= np.maximum(both * all_c, 1)
    gain[both <= 0] = 0
    top = gain.max(axis=3)
    place = (gain >= top[..., None] * (1 - 1e-12)).argmax(axis=3)  # the first of equal ones
    at = np.ix_(*map(np.arange, place.shape))
    found, found_low = gain[(*at, place)], rl[(*at, place)]
    for i, (j, held) in enumerate(cells.held.items()):
        better = found[..., i] > best * (1 + 1e-12) + 1e-300
        best[better], feature[better], cut[better] = found[..., i][better], j, held[place[..., i][better]]
        low[better] = found_low[..., i][better]
    return feature, cut, low, here


def _number(c: str) -> Column:
    """A feature as a number; null and NaN come before all others."""
    x = F.col(c).cast("double")
    return F.when(x.isNull() | F.isnan(x), float("-inf")).otherwise(x)


def _bin(c: str, cuts: list[float]) -> Column:
    """How many cut points lie below the value."""
    points = F.array(*[F.lit(v) for v in cuts]).cast("array<double>")
    return F.size(F.filter(points, lambda v: v < _number(c))).cast("tinyint")


def cut_points(rows: DataFrame, features: Sequence[str], bins: int = BINS) -> list[list[float]]:
    """Per feature the values that a bin may end with: at most bins - 1 quantiles below the largest value."""
    at = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(_number(c), at, 10_000).alias(f"q{j}") for j, c in enumerate(features)],
                     *[F.max(_number(c)).alias(f"m{j}") for j, c in enumerate(features)]).first()
    return [sorted({v for v in found[f"q{j}"] or [] if v < found[f"m{j}"]}) for j in range(len(features))]


def fit(rows: DataFrame, features: Sequence[str], s: Settings, fold: Column | None = None, folds: DataFrame | None = None, seed: int = 0, most: int = MOST_ENTRIES) -> Model:
    """Models of rows(label BOOLEAN, features…): one that uses all, and one without each fold of `folds` (a column `fold`).

    Without training rows of its own a fold needs no model: the one on all rows never saw it.
    """
    features = list(features)
    cuts = cut_points(rows, features)
    entries = _entries(rows, features, fold, cuts)
    wanted = None if folds is None else folds.select(F.col("fold").cast("string").alias("fold")).distinct()
    return Model(_grown(entries, wanted, None, cuts, s, seed, most).select("fold", "base", "trees"), features, s.depth)


def held_out(rows: DataFrame, all_rows: DataFrame, features: Sequence[str], s: Settings, fold: Column, seed: int = 0, most: int = MOST_ENTRIES, name: str = "raw") -> tuple[Model, DataFrame]:
    """The model on all rows, and all_rows with their probability under the model that leaves out their fold.

    The models of the folds stay in the tasks that grow them: equal bins of a fold have one score, and a row
    takes that of its bins, so neither rows nor trees travel together. Folds without training rows, and rows
    without a fold, are scored by the model on all rows.
    """
    features = list(features)
    cuts = cut_points(rows, features)
    entries, names = _entries(rows, features, fold, cuts), [f"b{j}" for j in range(len(features))]
    binned = all_rows.select("*", fold.cast("string").alias("_fold"), *[_bin(f, c).alias(f"_{b}") for b, f, c in zip(names, features, cuts, strict=True)])
    own = ["_fold", *[f"_{b}" for b in names]]
    trained = entries.select(F.col("fold").alias("_fold")).where("_fold IS NOT NULL").distinct()
    asked = binned.select(*own).join(trained, "_fold", "left_semi").distinct().toDF("fold", *names)
    grown = _grown(entries, trained.toDF("fold"), asked, cuts, s, seed, most)
    model = Model(grown.where("trees IS NOT NULL").select("fold", "base", "trees"), features, s.depth)
    scores = grown.where("trees IS NULL").select("fold", *names, "raw").toDF(*own, name)
    known = binned.join(scores, own).select(*all_rows.columns, name)
    rest = binned.join(trained, "_fold", "left_anti").select(*all_rows.columns)
    return model, known.unionByName(predict(model, rest, name))


def _entries(rows: DataFrame, features: list[str], fold: Column | None, cuts: list[list[float]]) -> DataFrame:
    """Rows equal in fold, label and bins as one row with a weight."""
    own = (F.lit(None) if fold is None else fold).cast("string").alias("fold")
    names = [f"b{j}" for j in range(len(features))]
    binned = [_bin(f, c).alias(b) for b, f, c in zip(names, features, cuts, strict=True)]
    labelled = rows.where("label IS NOT NULL").select(own, F.col("label").cast("int").alias("label"), *binned)
    return cut_lineage(labelled.groupBy("fold", "label", *names).agg(F.count("*").cast("double").alias("w")))


def _grown(entries: DataFrame, wanted: DataFrame | None, asked: DataFrame | None, cuts: list[list[float]], s: Settings, seed: int, most: int) -> DataFrame:
    """(fold, base, trees) of the model on all entries and, if no rows are asked for, of the model without each wanted fold;
    else (fold, b…, raw) of each row asked for under the model without its fold."""
    spark, names = entries.sparkSession, [f"b{j}" for j in range(len(cuts))]
    cells = cut_lineage(entries.groupBy(*names).agg(*[F.sum(F.when(F.col("label") == i, F.col("w")).otherwise(0.0)).alias(c) for i, c in enumerate(("neg", "pos"))]))
    n = cells.count()
    if n > most:
        cells = cells.where(F.pmod(F.xxhash64(*names), F.lit(1 << 30)) < int(most / n * (1 << 30)))
    shared = spark.sparkContext.broadcast((cells.toArrow(), cuts))
    none = {"fold": "string", "label": "int", **dict.fromkeys(names, "tinyint"), "w": "double"}
    given = spark.range(1).select(*[F.lit(None).cast(kind).alias(c) for c, kind in none.items()])  # the model that leaves nothing out
    if wanted is not None:
        given = given.unionByName(entries.join(wanted, "fold", "left_semi"))
    if asked is not None:
        given = given.unionByName(asked, allowMissingColumns=True)

    def run(batches):
        table, edges = shared.value
        c = Cells(table, len(edges), [len(e) for e in edges])
        block = max(1, BLOCK_CELLS // max(1, len(c)))
        kind = pa.list_(pa.struct([("f", pa.list_(pa.int32())), ("c", pa.list_(pa.float64())), ("v", pa.list_(pa.float64()))]))
        for held in _folds_together(batches, block):
            fold = held.column("fold").combine_chunks().dictionary_encode(null_encoding="encode")
            model, names_of = fold.indices.to_numpy(zero_copy_only=False), fold.dictionary
            weighed, binned = (held.column(x).is_valid().to_numpy() for x in ("w", "b0"))
            own, ask = (held.take(pa.array(np.flatnonzero(x))) for x in (weighed, binned & ~weighed))
            at, known = c.find(own, len(edges))
            left = (own.column("label").to_numpy()[known], model[weighed][known], at[known], own.column("w").to_numpy()[known])
            whose = model[binned & ~weighed]
            at = [i for i, f in enumerate(names_of.to_pylist()) if f is None or asked_none]
            base, trees, raw = grow(c, names_of.to_pylist(), left, (whose, _keys(ask, len(edges))[0]), s, edges, seed, at)
            k = len(at)
            bins = [pa.concat_arrays([pa.nulls(k, pa.int8()), ask.column(f"b{j}").combine_chunks()]) for j in range(len(edges))]
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([names_of.take(pa.array(at, pa.int64())), names_of.take(pa.array(whose))]), *bins,
                 pa.concat_arrays([pa.array([base[i] for i in at], pa.float64()), pa.nulls(len(ask), pa.float64())]),
                 pa.concat_arrays([pa.array([trees[i] for i in at], kind), pa.nulls(len(ask), kind)]),
                 pa.concat_arrays([pa.nulls(k, pa.float64()), pa.array(1 / (1 + np.exp(-raw)))])],
                names=["fold", *[f"b{j}" for j in range(len(edges))], "base", "trees", "raw"])

    asked_none = asked is None
    schema = ", ".join(["fold string", *[f"{b} tinyint" for b in names], TREES.split(", ", 1)[1], "raw double"])
    spread = given.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), F.xxhash64("fold")).sortWithinPartitions("fold")
    return cut_lineage(spread.mapInArrow(run, schema))


def _folds_together(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.Table]:
    """Entries sorted by fold, as tables of whole folds, up to `block` of them."""
    kept, folds, last = [], 0, ()
    for batch in batches:
        names = batch.column(0).to_pylist()
        start = 0
        for i, name in enumerate(names):
            if (name,) != last:
                if folds == block:
                    yield pa.Table.from_batches([*kept, batch.slice(start, i - start)])
                    kept, folds, start = [], 0, i
                folds, last = folds + 1, (name,)
        kept.append(batch.slice(start))
    if folds:
        yield pa.Table.from_batches(kept)


def predict(model: Model, rows: DataFrame, name: str = "raw", fold: Column | None = None) -> DataFrame:
    """Adds the probability of the label under the model without the row's fold (without fold: the one on all rows).

    Trees join after the last exchange of the rows, which would otherwise carry them.
    """
    if fold is None:
        return _predict_all(model, rows, name)
    every = F.broadcast(model.rows.where("fold IS NULL").select(F.struct("base", "trees").alias("_all")))  # one row
    d = rows.withColumn("_x", F.array(*[_number(f) for f in model.features]))
    own = model.rows.where("fold IS NOT NULL").select(F.col("fold").alias("_fold"), F.struct("base", "trees").alias("_own"))
    d = d.withColumn("_fold", fold.cast("string")).join(own, "_fold", "left").crossJoin(every).withColumn("_m", F.coalesce("_own", "_all"))
    return d.select(*rows.columns, _probability(model.depth).alias(name))


def _predict_all(model: Model, rows: DataFrame, name: str) -> DataFrame:
    """Scores under the model on all rows: rows between the same cuts of every feature have one score, worked out once."""
    every = F.broadcast(model.rows.where("fold IS NULL").select(F.struct("base", "trees").alias("_m")))  # one row
    splits = model.rows.where("fold IS NULL").select(F.explode("trees").alias("t")).select(F.explode(F.arrays_zip("t.f", "t.c")).alias("s"))
    used = splits.select("s.*").where(F.col("c") < float("inf")).distinct().collect()  # at most BINS a feature
    cuts = [sorted(r.c for r in used if r.f == j) for j in range(len(model.features))]
    bins = [f"_b{j}" for j in range(len(cuts))]
    binned = rows.select("*", *[_bin(f, c).alias(b) for b, f, c in zip(bins, model.features, cuts, strict=True)])
    ends = [F.coalesce(F.get(F.array(*[F.lit(v) for v in c]).cast("array<double>"), F.col(b).cast("int")), F.lit(float("inf"))) for b, c in zip(bins, cuts, strict=True)]
    scores = binned.select(*bins).distinct().withColumn("_x", F.array(*ends)).crossJoin(every).select(*bins, _probability(model.depth).alias(name))
    return binned.join(scores, bins).select(*rows.columns, name)


def _probability(depth: int) -> Column:
    """The probability that the model _m gives the features _x."""
    levels = F.array(*[F.lit(i) for i in range(depth)])

    def value(t):
        leaf = F.aggregate(levels, F.lit(0), lambda at, _: 2 * at + 1 + (F.get("_x", F.get(t["f"], at)) > F.get(t["c"], at)).cast("int"))
        return F.get(t["v"], leaf - (2**depth - 1))

    return 1 / (1 + F.exp(-F.aggregate("_m.trees", F.col("_m.base"), lambda s, t: s + value(t))))
