"""Quality of texts by a sparse ensemble of rules, compiled to column expressions.

Small boosted trees over text statistics are cut into rules, one for each path from the root: a conjunction of bounds on
statistics. A logistic model with an absolute penalty on rules and clipped statistics keeps few of them. What remains is a
sum of ``when`` expressions, so that scoring is a projection.

The statistics are built-in functions over the whole text: shares of kinds of characters and words, means, distinct and
repeated words.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gramwise.session import stored

THRESHOLD = 0.7


def text_statistics(rows: DataFrame, text: str = "text") -> DataFrame:
    """The other columns and the statistics of a text; a null text is taken as empty, and all are 0 for it.

    Counts come first, each from one pass over the text, then shares: so no count is evaluated twice.
    """
    others = [c for c in rows.columns if c != text]
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    taken = lambda pattern: F.char_length("text") - F.char_length(F.regexp_replace("text", pattern, ""))
    matches = lambda pattern: F.regexp_count("text", F.lit(pattern))
    start, stop = "(?:^|[\\x20\\x0A])", "(?:$|[\\x20\\x0A])"
    counts = {
        "chars": F.char_length("text"),
        "words": F.size("w"),
        "inside": taken("[\\x20\\x09-\\x0D]+"),
        "letters": taken("\\p{L}+"),
        "capitals": taken("\\p{Lu}+"),
        "digits": taken("\\p{Nd}+"),
        "marks": taken("[.,;:!?]+"),
        "symbols": taken("[\\p{S}#$%&*|<>=_~^@\\\\/+]+"),
        "lines": matches("\\n"),
        "sentence_ends": matches("[.!?]" + stop),
        "shouts": matches("[!?]{2,}"),
        "symbol_words": matches(start + "[^\\p{L}\\p{Nd}\\x20\\x0A]+(?=" + stop + ")"),
        "marked_words": matches("[#$%&*|~^@+=<>_]{2,}"),
        "distinct_words": F.size(F.array_distinct("w")),
        "doubled_words": matches(start + "([^\\x20\\x09-\\x0D]+)(?=[\\x20\\x0A]\\1" + stop + ")"),
    }
    whole = rows.select(*others, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("w", words)
    counted = whole.select(*others, *[c.cast("double").alias(f"__{name}") for name, c in counts.items()])
    per = lambda part, whole: F.when(F.col(f"__{whole}") > 0, F.col(f"__{part}") / F.col(f"__{whole}")).otherwise(0.0).alias(part)
    return counted.select(
        *others,
        F.log1p("__chars").alias("log_chars"),
        F.log1p("__words").alias("log_words"),
        F.when(F.col("__words") > 0, (F.col("__chars") - F.col("__inside")) / F.col("__words")).otherwise(0.0).alias("word_length"),
        *[per(c, "chars") for c in STATISTICS[3:8]],
        *[per(c, "words") for c in STATISTICS[8:]],
    )


STATISTICS = ("log_chars", "log_words", "word_length", "letters", "capitals", "digits", "marks", "symbols", "lines", "sentence_ends", "shouts", "symbol_words", "marked_words", "distinct_words", "doubled_words")


@dataclass
class RuleEnsemble:
    """intercept + sum of weights of the rules that hold + sum of slopes times clipped statistics.

    A rule is a list of (statistic, lower bound excluded or None, upper bound included or None); all must hold.
    """

    intercept: float
    rules: list[tuple[list[tuple[str, float | None, float | None]], float]] = field(default_factory=list)
    slopes: list[tuple[str, float, float, float]] = field(default_factory=list)
    """(statistic, lowest, highest, slope)"""

    def logit(self) -> Column:
        """The model as one column expression over the statistics' columns."""
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            holds = F.lit(True)
            for name, low, high in rule:
                holds = holds if low is None else holds & (F.col(name) > low)
                holds = holds if high is None else holds & (F.col(name) <= high)
            total = total + F.when(holds, F.lit(float(weight))).otherwise(0.0)
        for name, low, high, slope in self.slopes:
            total = total + F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.col(name))) * F.lit(float(slope))
        return total

    def score(self) -> Column:
        return 1.0 / (1.0 + F.exp(-self.logit()))

    def values(self, rows: np.ndarray, names: Sequence[str]) -> np.ndarray:
        """The same scores from a matrix of statistics."""
        at, total = {name: j for j, name in enumerate(names)}, np.full(len(rows), float(self.intercept))
        for rule, weight in self.rules:
            total += weight * _holds(rows, [(at[name], low, high) for name, low, high in rule])
        for name, low, high, slope in self.slopes:
            total += slope * np.clip(rows[:, at[name]], low, high)
        return 1.0 / (1.0 + np.exp(-total))

    def dump(self) -> str:
        return json.dumps([self.intercept, self.rules, self.slopes])

    @staticmethod
    def load(raw: str) -> RuleEnsemble:
        intercept, rules, slopes = json.loads(raw)
        return RuleEnsemble(intercept, [([tuple(b) for b in rule], weight) for rule, weight in rules], [tuple(s) for s in slopes])


def _holds(rows: np.ndarray, rule) -> np.ndarray:
    out = np.ones(len(rows), bool)
    for j, low, high in rule:
        if low is not None:
            out &= rows[:, j] > low
        if high is not None:
            out &= rows[:, j] <= high
    return out


def grow_rules(rows: np.ndarray, labels: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.2, bins: int = 48, share: float = 0.6, least: int = 20, seed: int = 1) -> list:
    """Paths of boosted trees on random halves of rows and statistics: [(column, low, high), ...], each bound once."""
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in rows.T]
    binned = np.stack([np.searchsorted(e, column, "left") for e, column in zip(edges, rows.T, strict=True)], axis=1)
    margin = np.full(len(rows), np.log((labels.mean() + 1e-3) / (1 - labels.mean() + 1e-3)))
    found: dict[tuple, None] = {}

    def split(at: np.ndarray, gradient: np.ndarray, weight: np.ndarray, columns: np.ndarray):
        best = (1e-6, None, None)
        g, h = gradient[at], weight[at]
        base = g.sum() ** 2 / (h.sum() + 1.0)
        for j in columns:
            if not len(edges[j]):
                continue
            width = len(edges[j]) + 1
            gs, hs, ns = (np.cumsum(np.bincount(binned[at, j], w, width))[:-1] for w in (g, h, np.ones(len(at))))
            gain = gs**2 / (hs + 1.0) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1.0) - base
            gain[(ns < least) | (len(at) - ns < least)] = -1.0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], j, k)
        return best[1:]

    def grow(at: np.ndarray, path: tuple, gradient, weight, columns) -> None:
        if path:
            found.setdefault(_merged(path))
        j, k = split(at, gradient, weight, columns) if len(path) < depth else (None, None)
        if j is None:
            leaf = path
            margin[_holds(rows, leaf)] += rate * gradient[at].sum() / (weight[at].sum() + 1.0)
            return
        cut, low = float(edges[j][k]), binned[at, j] <= k
        grow(at[low], (*path, (j, None, cut)), gradient, weight, columns)
        grow(at[~low], (*path, (j, cut, None)), gradient, weight, columns)

    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        columns = rng.permutation(rows.shape[1])[: max(1, int(share * rows.shape[1]))]
        grow(np.flatnonzero(rng.random(len(rows)) < 0.5), (), labels - p, p * (1 - p), columns)
    return list(found)


def _merged(path: tuple) -> tuple:
    bounds: dict[int, list] = {}
    for j, low, high in path:
        own = bounds.setdefault(j, [None, None])
        own[0] = low if own[0] is None else own[0] if low is None else max(own[0], low)
        own[1] = high if own[1] is None else own[1] if high is None else min(own[1], high)
    return tuple(sorted((int(j), *b) for j, b in bounds.items()))


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray | None = None, steps: int = 400, tol: float = 1e-6) -> np.ndarray:
    """(intercept, weights) of least mean logistic loss plus penalty times the sum of absolute weights.

    Accelerated proximal gradient on the columns given; the intercept bears no penalty.
    """
    x = np.column_stack([np.ones(len(x)), x])
    theta = np.zeros(x.shape[1]) if start is None else start.copy()
    step = 4.0 * len(x) / max(np.linalg.norm(x, 2) ** 2, 1e-12)
    look, pace = theta.copy(), 1.0
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ look, -35, 35)))
        new = look - step * (x.T @ (p - y)) / len(x)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0.0)
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        look, moved, pace = new + (pace - 1) / faster * (new - theta), np.abs(new - theta).max(), faster
        theta = new
        if moved < tol:
            break
    return theta


def fit_rules(rows: np.ndarray, labels: np.ndarray, names: Sequence[str], seed: int = 1) -> RuleEnsemble:
    """Rules from trees, then the penalty of smallest log loss on a quarter of the rows left out, then all rows.

    With one label only (or none at all) the model is a constant: that label's smoothed share.
    """
    share = (labels.sum() + 1.0) / (len(labels) + 2.0)
    constant = RuleEnsemble(float(np.log(share / (1 - share))))
    if len(labels) < 8 or labels.min() == labels.max():
        return constant
    rules = grow_rules(rows, labels, seed=seed)
    low, high = np.quantile(rows, [0.025, 0.975], axis=0)
    clipped = np.clip(rows, low, high)
    spread = clipped.std(axis=0)
    used = np.flatnonzero(spread > 1e-12)
    columns = [_holds(rows, rule).astype(float) for rule in rules]
    # statistics are scaled so that they pay as much penalty as an average rule
    x = np.column_stack([*columns, 0.4 * (clipped[:, used] - clipped[:, used].mean(axis=0)) / spread[used]]) if columns or len(used) else np.zeros((len(rows), 0))
    if not x.shape[1]:
        return constant
    aside = np.arange(len(rows)) % 4 == 3
    grid, theta, losses = np.geomspace(0.03, 3e-4, 10), None, []
    for penalty in grid:
        theta = lasso_logistic(x[~aside], labels[~aside], penalty, theta)
        p = 1.0 / (1.0 + np.exp(-(theta[0] + x[aside] @ theta[1:])))
        y = labels[aside]
        losses.append(-np.mean(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12)))
    theta = lasso_logistic(x, labels, grid[int(np.argmin(losses))], theta)
    weights, slopes = theta[1 : 1 + len(rules)], 0.4 * theta[1 + len(rules) :] / spread[used]
    kept = [([(names[j], a, b) for j, a, b in rule], float(w)) for rule, w in zip(rules, weights, strict=True) if w]
    lines = [(names[j], float(low[j]), float(high[j]), float(s)) for j, s in zip(used, slopes, strict=True) if s]
    return RuleEnsemble(float(theta[0] - (slopes * clipped[:, used].mean(axis=0)).sum()), kept, lines)


def learn(rows: DataFrame, label: str, trainable: Column, key: str = "doc_id", sample: int = 20_000) -> RuleEnsemble:
    """Fit on at most ``sample`` labelled rows of the statistics table, those of smallest key hash: a documented bound.

    The fit runs in one task on that sample; only the rules come back.
    """
    marked = rows.where(trainable & F.col(label).isin(0, 1)).withColumn("order", F.xxhash64(F.col(key).cast("string")))
    first = marked.select("order", F.col(label).cast("double").alias("label"), *STATISTICS).orderBy("order", *STATISTICS, "label").limit(sample)

    def train(batches):
        frame = pd.concat([pd.DataFrame({c: [] for c in ("order", "label", *STATISTICS)}), *batches]).sort_values(["order", *STATISTICS, "label"])
        model = fit_rules(frame[list(STATISTICS)].to_numpy(float), frame["label"].to_numpy(float), STATISTICS)
        yield pd.DataFrame({"model": [model.dump()]})

    found = first.repartition(1).mapInPandas(train, "model string").collect()
    return RuleEnsemble.load(found[0]["model"]) if found else RuleEnsemble(0.0)


def held_out(key: str = "doc_id") -> Column:
    """The fold whose labels are never used: crc32 of the key's text is 2 modulo 4; so is a row without key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(True))


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", sample: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row: how likely its label is 1, from its text alone.

    Statistics of all texts are stored once (fifteen numbers a row); labelled rows of the folds not held out train, all
    rows are scored by the compiled rules. A null or empty text has a score like any other. A document with several
    labels trains with each, one with a null label with none; repeated rows are scored as often as they come. Without
    labels all scores are one half.
    """
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    statistics = stored(text_statistics(narrow), "statistics")
    marks = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    model = learn(statistics.join(marks, "doc_id"), "label", ~held_out("doc_id"), "doc_id", sample)
    scored = statistics.select("doc_id", held_out("doc_id").alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
