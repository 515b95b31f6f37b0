"""Quality classification by a sparse ensemble of rules.

Boosted shallow trees are grown over statistics of the text; every path from a root to a node is a
rule, a conjunction of thresholds.  Logistic regression with an L1 penalty picks and weighs rules.
The model is a Spark column expression over the statistics, which are expressions over the text,
so scoring stays in generated code and needs no Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.rows import packed, unpacked

WORDS = r"[^\x20\x09-\x0D]+"
NAMES = ("chars", "words", "word_length", "distinct", "symbols", "upper", "digits", "marks", "bars", "line_length")


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of the whole text; null counts as empty, and shares of nothing are 0.

    chars and words are logarithms; distinct is the share of words that differ from all others;
    symbols, upper and digits are shares of characters; marks and bars count `!` and ` | ` for each
    word; line_length is the logarithm of words for each line.
    """
    plain = F.coalesce(text, F.lit(""))
    chars = F.length(plain).cast("double")
    split = F.split(F.lower(plain), r"[\x20\x09-\x0D]+")
    words = F.size(split).cast("double")
    share = lambda n, of: F.coalesce(F.try_divide(n.cast("double"), of), F.lit(0.0))
    count = lambda pattern: F.regexp_count(plain, F.lit(pattern))
    without = lambda s: F.length(plain) - F.length(F.replace(plain, F.lit(s)))
    return {
        "chars": F.log1p(chars),
        "words": F.log1p(words),
        "word_length": share(chars, words),
        "distinct": share(F.size(F.array_distinct(split)), words),
        "symbols": share(count(r"[^\p{L}\p{N}\s]"), chars),
        "upper": share(count(r"\p{Lu}"), chars),
        "digits": share(count(r"[0-9]"), chars),
        "marks": share(without("!"), words),
        "bars": share(without(" | "), words),
        "line_length": F.log1p(share(words, (without("\n") + 1).cast("double"))),
    }


#: (statistic, above its threshold?, threshold)
Condition = tuple[int, bool, float]


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            z += weight * holds(rule, x)
        return 1 / (1 + np.exp(-z))


def holds(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for at, above, threshold in rule:
        out &= (x[:, at] > threshold) == above
    return out


def _paths(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, rows: np.ndarray, depth: int, least: int) -> list[tuple[Condition, ...]]:
    """The paths of one regression tree, grown greedily by the gain in squared error."""
    found = []

    def grow(rows: np.ndarray, path: tuple[Condition, ...]) -> None:
        if path:
            found.append(path)
        best = None
        if len(path) < depth and len(rows) >= 2 * least:
            total = gradient[rows].sum()
            for at in range(x.shape[1]):
                n = np.bincount(bins[rows, at], minlength=len(edges[at]) + 1).cumsum()[:-1]
                s = np.bincount(bins[rows, at], weights=gradient[rows], minlength=len(edges[at]) + 1).cumsum()[:-1]
                ok = (n >= least) & (len(rows) - n >= least)
                if not ok.any():
                    continue
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(ok, s**2 / n + (total - s) ** 2 / (len(rows) - n) - total**2 / len(rows), -np.inf)
                k = int(gain.argmax())
                if best is None or gain[k] > best[0]:
                    best = gain[k], at, k
        if best is None or best[0] <= 1e-9:
            return
        _, at, k = best
        above = bins[rows, at] > k
        grow(rows[~above], (*path, (at, False, float(edges[at][k]))))
        grow(rows[above], (*path, (at, True, float(edges[at][k]))))

    grow(rows, ())
    return found


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty by accelerated proximal gradients; columns of z are standardised."""
    n = len(y)
    step = 4 * n / max(1e-9, np.linalg.norm(np.column_stack([np.ones(n), z]), 2) ** 2)
    w, b = np.zeros(z.shape[1]), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    u, c, t = w, b, 1.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-np.clip(z @ u + c, -30, 30))) - y
        moved = u - step * (z.T @ error) / n
        new, new_b = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0), c - step * error.mean()
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        u, c = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    return b, w


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 20, depth: int = 3, least: int = 10, rate: float = 0.3, penalty: float = 0.002, seed: int = 42) -> Model:
    """A model of y (0 or 1) given statistics x.  Without both classes it is a constant."""
    if not len(y) or y.min() == y.max():
        return Model(10.0 if len(y) and y.min() == 1 else -10.0 if len(y) else 0.0, ())
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, 65)[1:-1])) for column in x.T]
    bins = np.column_stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T, strict=True)])
    random, margin = np.random.default_rng(seed), np.zeros(len(y))
    rules: dict[tuple[Condition, ...], None] = {}
    for _ in range(trees):
        gradient = y - 1 / (1 + np.exp(-margin))
        rows = np.sort(random.choice(len(y), size=max(1, len(y) * 4 // 5), replace=False))
        paths = _paths(x, bins, edges, gradient, rows, depth, min(least, max(1, len(y) // 20)))
        rules |= dict.fromkeys(paths)
        margin += 4 * rate * _fitted(paths, x, gradient, rows)
    columns, kept = [], []
    for rule in rules:
        on = holds(rule, x).astype(float)
        if 0 < on.mean() < 1:
            columns.append((on - on.mean()) / on.std())
            kept.append((rule, on.mean(), on.std()))
    if not kept:
        return Model(math.log(y.mean() / (1 - y.mean())), ())
    b, w = _lasso(np.column_stack(columns), y, penalty)
    chosen = [(rule, weight / std, mean) for (rule, mean, std), weight in zip(kept, w, strict=True) if weight]
    return Model(b - sum(weight * mean for _, weight, mean in chosen), tuple((rule, float(weight)) for rule, weight, _ in chosen))


def _fitted(paths: list[tuple[Condition, ...]], x: np.ndarray, gradient: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A tree's values on all rows: those of its leaves, paths that no other path goes on from."""
    out = np.zeros(len(x))
    inner = {p[:i] for p in paths for i in range(len(p))}
    of_tree = np.zeros(len(x), dtype=bool)
    of_tree[rows] = True
    for path in paths:
        if path not in inner:
            on = holds(path, x)
            if (on & of_tree).any():
                out[on] = gradient[on & of_tree].mean()
    return out


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = 8000, **how) -> Model:
    """A model from a bounded sample of labelled rows: the max_rows labels whose ids have the least hash.

    That many ids are broadcast to the documents, and their statistics (ten numbers a row) come to
    the driver, max_rows of them at most however often documents repeat an id.  Null labels and ids are left out;
    an id with several labels gives several rows.
    """
    some = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    some = some.orderBy(F.xxhash64("_id"), "_id", "_label").limit(max_rows)
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(some), "_id")
    measured = found.select("_id", "_label", *(c.alias(k) for k, c in statistics(F.col("_text")).items()))
    measured = measured.orderBy(F.xxhash64("_id"), *measured.columns).limit(max_rows)
    rows = sorted(map(tuple, measured.collect()))
    x = np.array([r[2:] for r in rows], dtype=float).reshape(-1, len(NAMES))
    return fit_rules(x, np.array([r[1] for r in rows], dtype=float), **how)


def compiled(model: Model, stats: dict[str, Column]) -> Column:
    """The model as one expression of the statistics' columns: a probability."""
    columns = list(stats.values())
    total = F.lit(model.intercept)
    for rule, weight in model.rules:
        on = None
        for at, above, threshold in rule:
            one = columns[at] > threshold if above else columns[at] <= threshold
            on = one if on is None else on & one
        total = total + F.when(on, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs, all columns, with _score: the probability of label 1.  Null and empty texts have one too.

    Nothing is added to the score, but what is added is not deterministic to the optimizer: so a
    filter on the score is not pushed below it, where every rule would compute its statistics anew.
    """
    stats = statistics(F.col(text_col))
    rows = docs.withColumn("_stats", F.struct(*(c.alias(k) for k, c in stats.items())))
    score = compiled(model, {k: F.col(f"_stats.{k}") for k in stats})
    return rows.withColumn("_score", score + F.rand(0) * F.lit(0.0)).drop("_stats")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose score is at least the threshold, with their columns."""
    return unpacked(scored(packed(docs, text_col), model, text_col).where(F.col("_score") >= threshold))
