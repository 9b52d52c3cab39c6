"""Mixing to target weights with soft domain membership, in DataFrame operations only.

1. A Gaussian naive Bayes classifier is learnt from the labelled documents: per domain the mean
   and variance of a few statistics of the text (one aggregation). It gives every document a
   posterior over the domains.
2. Rates x >= 0, one per document, are fitted so that the expected token totals of the domains,
   sum_i x_i * n_i * p_i, match the targets: projected gradient steps on the least squares
   residual r, preconditioned by the second moment G = sum_i n_i p_i p_i' (domains x domains), so
   the unit step is the Lipschitz bound and the condition of the data does not slow it down.
   A step moves x_i by -p_i' G^-1 r and clips it to [0, most]. Only r (a number per domain)
   travels between steps; a document's rate is a fold over the steps' vectors.

With an upper bound of the rates the targets may be out of reach. The largest budget B whose
targets B w can be met is the least of most * sum_i n_i max(0, l' p_i) over all l with l' w = 1
(duality of linear programs); fit(feasible=True) lowers the budget to it. For two domains l is
searched along its line, for others only the corners l = e_k / w_k are looked at, and `residual`
of the mix says how far the expected totals are from the targets.

Nulls: a null text counts as an empty one (no tokens; its rate follows from its posterior).
Labels without a document, null labels and null ids are ignored; of several labels of one
document the largest counts. Without any labels every rate is 1 and the posteriors are empty.
Targets of domains that have no labels are ignored, domains without a target get weight 0.
Rows of equal doc_id are rated one by one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmill.llm.scratch import Scratch, free_name

STEPS = 60
TOLERANCE = 1e-9
LEAST_VARIANCE = 1e-4
#: Token shares wanted of documents labelled 0 (low quality) and 1 (high quality).
WEIGHTS = {0: 0.05, 1: 0.95}


@dataclass
class Mix:
    """A fitted mix: the domains, the classifier's parameters and the steps that were taken."""

    domains: list[int] = field(default_factory=list)
    priors: list[float] = field(default_factory=list)
    means: list[list[float]] = field(default_factory=list)
    variances: list[list[float]] = field(default_factory=list)
    steps: list[list[float]] = field(default_factory=list)
    most: float | None = None
    targets: list[float] = field(default_factory=list)
    totals: list[float] = field(default_factory=list)

    @property
    def residual(self) -> float:
        """The largest distance of a domain's expected share of the drawn tokens from the share wanted; nan if nothing is drawn."""
        if not sum(self.totals) or not sum(self.targets):
            return float("nan")
        return float(np.abs(np.array(self.totals) / sum(self.totals) - np.array(self.targets) / sum(self.targets)).max())


def _text(text: str) -> Column:
    return F.coalesce(F.col(f"`{text}`"), F.lit(""))


N_STATISTICS = 5


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often `then` uses it."""
    return F.transform(F.array(value), then)[0]


def statistics(text: str = "text") -> Column:
    """Length, word length, share of marks, variety of words and of lines; last, the number of tokens (words)."""

    def of(t, words, lines, n):
        empty = (words[0] == "").cast("int") + ((n > 1) & (F.element_at(words, -1) == "")).cast("int")
        return F.array(
            F.log1p(n),
            F.length(t) / n,
            F.log1p(F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\s]+")) / n),
            F.size(F.array_distinct(words)) / n,
            F.size(F.array_distinct(lines)) / (F.size(lines) + F.lit(0.0)),
            n - empty,
        )

    return let(_text(text), lambda t: let(F.split(t, r"\s+"), lambda words: let(F.split(t, "\n"), lambda lines: let(F.size(words) + F.lit(0.0), lambda n: of(t, words, lines, n)))))


def _number(x: float) -> Column:
    return F.lit(float(x))


def _posterior(mix: Mix, stats: Column) -> Column:
    """Class probabilities in the order of mix.domains."""
    if not mix.domains:
        return F.array().cast("array<double>")

    def logs(s):
        out = []
        for prior, means, variances in zip(mix.priors, mix.means, mix.variances, strict=True):
            score = _number(np.log(prior) - 0.5 * sum(np.log(v) for v in variances))
            for i, (m, v) in enumerate(zip(means, variances, strict=True)):
                score = score - (s[i] - _number(m)) * (s[i] - _number(m)) / _number(2 * v)
            out.append(score)
        return F.array(*out)

    def normal(logs):
        return let(F.array_max(logs), lambda top: let(F.transform(logs, lambda x: F.exp(x - top)), lambda w: let(F.aggregate(w, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(w, lambda x: x / total))))

    return let(stats, lambda s: let(logs(s), normal))


def _rate(mix: Mix, posterior: Column) -> Column:
    """The rate after mix.steps, from 1 on; posterior must be a column or a bound variable."""
    if not mix.steps:
        return F.lit(1.0)
    moves = F.array(*(F.array(*(_number(v) for v in step)) for step in mix.steps))

    def move(x, step):
        x = x - F.aggregate(F.zip_with(posterior, step, lambda p, v: p * v), F.lit(0.0), lambda a, y: a + y)
        x = F.greatest(x, F.lit(0.0))
        return x if mix.most is None else F.least(x, _number(mix.most))

    return F.aggregate(moves, F.lit(1.0), move)


def measure(docs: DataFrame, scratch: Scratch, text: str = "text") -> DataFrame:
    """doc_id, n (tokens) and s (statistics) of every document, written once."""
    table = docs.select("doc_id", F.explode(F.array(statistics(text))).alias("s"))
    return scratch.save("stats", table.select("doc_id", F.col("s")[N_STATISTICS].cast("long").alias("n"), "s"))


def fit(docs: DataFrame, labels: DataFrame, weights: dict[int, float] = WEIGHTS, budget: float | None = None, most: float | None = None, text: str = "text", feasible: bool = False) -> Mix:
    """Fit a mix to docs (doc_id and a text) and labels (doc_id, domain).

    weights: wanted share of tokens per domain; budget: expected tokens in total (default: as
    many as there are); most: an upper bound of the rates; feasible: lower the budget to the largest
    one that rates up to `most` can meet.
    """
    scratch = Scratch(docs.sparkSession)
    mix = fit_table(measure(docs, scratch, text), labels, scratch, weights, budget, most, feasible)
    scratch.drop("stats")
    return mix


def _largest_budget(soft: DataFrame, weights: np.ndarray, most: float) -> float:
    """Upper bound of the tokens that rates up to `most` can draw by the weights; exact for two domains."""
    d = len(weights)

    def supports(lines: np.ndarray) -> np.ndarray:
        along = lambda line: sum((F.col("p")[i] * _number(line[i]) for i in range(1, d)), F.col("p")[0] * _number(line[0]))
        got = soft.agg(*(F.sum(F.col("n") * F.greatest(F.lit(0.0), along(line))).alias(f"h{k}") for k, line in enumerate(lines))).first()
        return most * np.array([float(x) for x in got])

    held = np.flatnonzero(weights > 0)
    if not len(held):
        return float("inf")
    corners = np.zeros((len(held), d))
    corners[np.arange(len(held)), held] = 1 / weights[held]
    best = supports(corners).min()
    if d == 2 and len(held) == 2:
        a = np.concatenate([-np.geomspace(1e4, 1e-2, 24), [0.0], np.geomspace(1e-2, 1e4, 24)])
        for _ in range(5):
            h = supports(np.stack([a, (1 - a * weights[0]) / weights[1]], axis=1))
            best, k = min(best, h.min()), int(h.argmin())
            a = np.linspace(a[max(k - 1, 0)], a[min(k + 1, len(a) - 1)], 33)
    return float(best)


def fit_table(table: DataFrame, labels: DataFrame, scratch: Scratch, weights: dict[int, float] = WEIGHTS, budget: float | None = None, most: float | None = None, feasible: bool = False) -> Mix:
    """fit() for a table made by measure()."""
    n = N_STATISTICS
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("domain").isNotNull()).groupBy("doc_id").agg(F.max("domain").alias("domain"))
    classes = (
        table.join(known, "doc_id").groupBy("domain")
        .agg(F.count("*").alias("rows"), *(F.avg(F.col("s")[i]).alias(f"m{i}") for i in range(n)), *(F.var_pop(F.col("s")[i]).alias(f"v{i}") for i in range(n)))
        .orderBy("domain").collect()
    )
    mix = Mix(most=most)
    if not classes:
        return mix
    rows = sum(c["rows"] for c in classes)
    mix.domains = [c["domain"] for c in classes]
    mix.priors = [c["rows"] / rows for c in classes]
    mix.means = [[c[f"m{i}"] for i in range(n)] for c in classes]
    mix.variances = [[c[f"v{i}"] + LEAST_VARIANCE for i in range(n)] for c in classes]
    soft = scratch.save("soft", table.select("n", _posterior(mix, F.col("s")).alias("p")))
    d = len(classes)
    sums = soft.agg(
        F.sum("n").alias("n"),
        *(F.sum(F.col("n") * F.col("p")[i] * F.col("p")[j]).alias(f"g{i}_{j}") for i in range(d) for j in range(i, d)),
    ).first()
    total = float(sums["n"] or 0)
    if total:
        moment = np.array([[sums[f"g{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) / total
        inverse = np.linalg.pinv(moment + 1e-12 * np.eye(d))
        shares = np.array([weights.get(k, 0.0) for k in mix.domains])
        share = (budget if budget is not None else total) / total
        if feasible and most is not None:
            share = min(share, _largest_budget(soft, shares, most) / total)
        mix.targets = list(shares * share)
        for _ in range(STEPS):
            x = _rate(mix, F.col("p"))
            got = soft.select("n", "p", x.alias("x")).agg(*(F.sum(F.col("n") * F.col("p")[i] * F.col("x")).alias(f"t{i}") for i in range(d))).first()
            mix.totals = [float(got[f"t{i}"]) / total for i in range(d)]
            step = inverse @ (np.array(mix.totals) - np.array(mix.targets))
            if np.abs(step).max() < TOLERANCE or (len(mix.steps) > 3 and np.abs(step - np.array(mix.steps[-1])).max() < TOLERANCE):
                break
            mix.steps.append([float(v) for v in step])
    scratch.drop("soft")
    return mix


def rated(stats: Column, mix: Mix) -> Column:
    """A struct of posterior and rate."""
    both = let(_posterior(mix, stats), lambda p: F.struct(p.alias("posterior"), _rate(mix, p).alias("rate")))
    return F.explode(F.array(both))


def quality_domains(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.col("quality").alias("domain"))


def mixing(docs: DataFrame, labels: DataFrame, weights: dict[int, float] = WEIGHTS, budget: float | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, posterior and rate."""
    scratch = Scratch(docs.sparkSession)
    table = measure(docs, scratch)
    mix = fit_table(table, quality_domains(labels), scratch, weights, budget)
    out = table.select("doc_id", F.col("n").alias("n_tokens"), rated(F.col("s"), mix).alias("r"))
    return out.select("doc_id", "n_tokens", F.col("r.posterior").alias("posterior"), F.col("r.rate").alias("rate"))


def draw(docs: DataFrame, mix: Mix) -> DataFrame:
    """Each document as often as its rate says on average, by a hash of its id; the columns of docs."""
    copies = free_name(docs, "mix_copies")
    fitted = let(_posterior(mix, statistics()), lambda p: _rate(mix, p))
    plain = docs.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.array(fitted)).alias(copies))
    chance = F.pmod(F.xxhash64(F.lit("mix"), F.coalesce(F.col("doc_id"), F.lit(0))), F.lit(1 << 30)) / F.lit(float(1 << 30))
    whole = F.floor(copies).cast("int")
    times = whole + (chance < F.col(copies) - whole).cast("int")
    out = plain.withColumn(copies, times).filter(F.col(copies) > 0)
    if mix.most is None or mix.most > 1:
        out = out.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
