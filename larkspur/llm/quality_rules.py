"""Quality classifier: a sparse rule ensemble (RuleFit).

Shallow boosted trees over text statistics are grown on a bounded sample of labelled rows; each path from a root to a
node is a conjunctive rule; a lasso-penalised logistic regression weighs the rules and leaves few; those become one
Spark column expression, so that scoring all documents is one scan without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stage

#: Labelled rows used for fitting at most, chosen by the hash of their id; the driver holds their statistics.
SAMPLE_ROWS = 20_000
TREES = 40
DEPTH = 3
BINS = 64
LEAST_LEAF = 25  # of small samples a fiftieth, at least 2
SHRINKAGE = 0.15
#: The lasso's penalty as a part of the smallest penalty at which no rule is left.
PENALTY = 0.003
SEED = 7


def _let(value: Column, then) -> Column:
    """then(value) with value computed once, however often it is used and wherever a filter pushes the result."""
    return F.transform(F.array(value), then)[0]


def statistics(text: Column) -> Column:
    """A struct of the statistics of _NAMES; a ratio over nothing is 0."""

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    def count(x: Column) -> Column:
        return F.size(x).cast("double")

    def parts(t: Column) -> Column:
        words = F.filter(F.split(t, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
        return F.struct(t.alias("t"), F.length(t).cast("double").alias("n"), words.alias("words"), F.split(t, "\n").alias("lines"))

    def of(x: Column) -> Column:
        t, n, words, lines = x["t"], x["n"], x["words"], x["lines"]

        def share(pattern: str) -> Column:
            return ratio(F.regexp_count(t, F.lit(pattern)).cast("double"), n)

        most = F.greatest(F.size(words) - 1, F.lit(0))
        repeats = F.filter(F.zip_with(F.slice(words, 1, most), F.slice(words, 2, most), lambda a, b: a == b), lambda v: v)
        found = {
            "s_length": F.log1p(n),
            "s_upper": share("[\\p{Lu}]"),
            "s_letters": share("[\\p{L}]"),
            "s_digits": share("[0-9]"),
            "s_stops": share("[.,]"),
            "s_bangs": share("!"),
            "s_marks": share("[#$%&*<>@^~=+_{}\\[\\]\\\\]"),
            "s_bars": share("[|]"),
            "s_line": ratio(count(F.array_distinct(lines)), count(lines)),
            "s_lines": ratio(count(lines), n),
            "s_words": F.log1p(count(words)),
            "s_word_length": ratio(n, count(words)),
            "s_distinct": ratio(count(F.array_distinct(words)), count(words)),
            "s_repeats": ratio(count(repeats), count(words)),
        }
        return F.struct(*[found[name].alias(name) for name in _NAMES])

    return _let(_let(F.coalesce(text, F.lit("")), parts), of)


_NAMES = ["s_length", "s_upper", "s_letters", "s_digits", "s_stops", "s_bangs", "s_marks", "s_bars", "s_line", "s_lines", "s_words", "s_word_length", "s_distinct", "s_repeats"]


@dataclass(frozen=True)
class Condition:
    """name <= cut, or name > cut."""

    name: str
    above: bool
    cut: float

    def column(self, x: Column) -> Column:
        return x[self.name] > self.cut if self.above else x[self.name] <= self.cut

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] > self.cut if self.above else x[self.name] <= self.cut


@dataclass
class RuleModel:
    """score = 1 / (1 + exp(-(intercept + the weights of the rules that hold)))."""

    intercept: float
    rules: list[tuple[float, frozenset[Condition]]]

    def column(self, x: Column) -> Column:
        """The score from a struct of statistics."""
        total = F.lit(float(self.intercept))
        for weight, rule in self.rules:
            held = None
            for c in sorted(rule, key=lambda c: (c.name, c.above, c.cut)):
                held = c.column(x) if held is None else held & c.column(x)
            total = total + F.when(held, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _grow(bins: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, path: frozenset, rules: set, out: np.ndarray) -> None:
    """A regression tree by second-order gains; adds each node's path to rules and the leaves' values to out."""
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-6, None)
    least = min(LEAST_LEAF, max(2, len(grad) // 50))
    if depth and len(rows) >= 2 * least:
        for f in range(bins.shape[1]):
            b = bins[rows, f]
            width = len(edges[f]) + 1
            gl = np.cumsum(np.bincount(b, grad[rows], width))[:-1]
            hl = np.cumsum(np.bincount(b, hess[rows], width))[:-1]
            nl = np.cumsum(np.bincount(b, minlength=width))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(nl < least) | (len(rows) - nl < least)] = 0
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), (f, int(gain.argmax())))
    if best[1] is None:
        out[rows] = -g / (h + 1)
        return
    f, at = best[1]
    left = bins[rows, f] <= at
    for above, part in ((False, rows[left]), (True, rows[~left])):
        here = path | {Condition(_NAMES[f], above, float(edges[f][at]))}
        rules.add(here)
        _grow(bins, edges, grad, hess, part, depth - 1, here, rules, out)


def fit_rules(x: dict[str, np.ndarray], y: np.ndarray) -> RuleModel:
    """Fit on statistics x and labels y of 0 and 1; without both labels, or any split, the model is the smoothed share of 1."""
    prior = (y.sum() + 1) / (len(y) + 2)
    if len(np.unique(y)) < 2:
        return RuleModel(float(np.log(prior / (1 - prior))), [])
    rng = np.random.default_rng(SEED)
    edges = []
    for name in _NAMES:
        values = np.unique(np.quantile(x[name], np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))
        above = np.searchsorted(np.unique(x[name]), values, "right")
        distinct = np.unique(x[name])
        edges.append(np.unique((values + distinct[np.minimum(above, len(distinct) - 1)]) / 2))
    bins = np.stack([np.searchsorted(e, x[name], "left") for e, name in zip(edges, _NAMES, strict=True)], axis=1)
    score = np.full(len(y), np.log(prior / (1 - prior)))
    rules: set[frozenset] = set()
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        rows = np.flatnonzero(rng.random(len(y)) < 0.5)
        out = np.zeros(len(y))
        found: set[frozenset] = set()
        _grow(bins, edges, p - y, p * (1 - p), rows, DEPTH, frozenset(), found, out)
        rules |= found
        value = np.zeros(len(y))
        for rule in sorted(found, key=len):  # the longest rule that holds is the leaf
            held = np.ones(len(y), bool)
            for c in rule:
                held &= c.holds(x)
            sample = held & np.isin(np.arange(len(y)), rows, assume_unique=True)
            value[held] = out[sample].mean() if sample.any() else 0
        score += SHRINKAGE * np.clip(value, -4, 4)
    if not rules:
        return RuleModel(float(np.log(prior / (1 - prior))), [])
    ordered = sorted(rules, key=lambda r: sorted((c.name, c.above, c.cut) for c in r))
    hold = np.ones((len(y), len(ordered)), np.float32)
    for j, rule in enumerate(ordered):
        for c in rule:
            hold[:, j] *= c.holds(x)
    _, first = np.unique(hold, axis=1, return_index=True)  # rules that hold for the same rows count once
    keep = np.sort(first)
    weights, intercept = lasso_logistic(hold[:, keep], y)
    return RuleModel(intercept, [(float(w), ordered[j]) for w, j in zip(weights, keep, strict=True) if w])


def lasso_logistic(hold: np.ndarray, y: np.ndarray, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the mean logistic loss plus the lasso penalty (FISTA, scaled rules)."""
    mean, spread = hold.mean(axis=0), np.maximum(hold.std(axis=0), 1e-3)
    z = (hold - mean) / spread
    n = len(y)
    base = y.mean()
    penalty = PENALTY * np.abs(z.T @ (y - base)).max() / n
    step = 4 * n / (np.linalg.norm(z, 2) ** 2 + n)
    w = v = np.zeros(z.shape[1])
    b = c = float(np.log(base / (1 - base)))
    t = 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-(z @ v + c))) - y
        new = v - step * (z.T @ r) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = c - step * r.mean()
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t_next * (new - w), new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new, new_b, t_next
    scaled = w / spread
    return scaled, float(b - (scaled * mean).sum())


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 2 when divided by 4; such rows are never learned from. False for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """The rule model of labels.quality. Rows without id, text's label or a label other than 0 and 1 are passed over."""
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("quality")]
    some = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id"))).select("doc_id", "quality").orderBy(*order).limit(sample_rows)
    some = stage(some, "labelled-sample")  # at most sample_rows rows
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    rows = rows.select("doc_id", "quality", statistics(F.col("text")).alias("s")).select("doc_id", "quality", "s.*")
    rows = rows.orderBy(*order, "s_length", "s_distinct").limit(sample_rows).toPandas()
    return fit_rules({name: rows[name].to_numpy(np.float64) for name in _NAMES}, rows["quality"].to_numpy(np.float64))


def score(text: Column, model: RuleModel) -> Column:
    """A whole text's score, without a shuffle. Null texts score as empty ones."""
    return _let(statistics(text), model.column)


def quality(docs: DataFrame, labels: DataFrame, cut: float = 0.7) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted (1 from cut on).

    Null and empty texts get the score of a text without words; long texts count whole; repeated rows get equal scores;
    no labels give the constant 0.5; more columns are ignored; no rows give no rows.
    """
    rows = docs.select("doc_id", "text")
    model = fit(rows, labels.select("doc_id", "quality"))
    out = rows.select("doc_id", score(F.col("text"), model).alias("score"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
