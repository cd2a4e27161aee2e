"""Quality scores by a sparse rule ensemble: paths of boosted trees as rules, weights by a lasso, all compiled to columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, text_of

BINS, DEPTH = 32, 3
#: A condition: the place of a statistic, whether it is to be above, and the threshold.
Condition = tuple[int, bool, float]
Rule = tuple[Condition, ...]


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text. The words and lines are found once each (see with_statistics)."""
    n, words, lines = F.length(text), F.col("_w"), F.col("_l")
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)).cast("double")
    left = lambda gone: F.length(F.regexp_replace(text, gone, ""))
    letters, n_words = left(r"\P{L}+"), F.size(words)
    return {
        "stat_chars": n.cast("double"),
        "stat_words": n_words.cast("double"),
        "stat_lines": F.size(lines).cast("double"),
        "stat_word_length": share(F.aggregate(words, F.lit(0), lambda s, w: s + F.length(w)), n_words),
        "stat_distinct_words": share(F.size(F.array_distinct(words)), n_words),
        "stat_distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "stat_line_length": share(n, F.size(lines)),
        "stat_short_words": share(F.size(F.filter(words, lambda w: F.length(w) <= 3)), n_words),
        "stat_letters": share(letters, n),
        "stat_upper": share(left(r"\P{Lu}+"), letters),
        "stat_digits": share(left(r"[^0-9]+"), n),
        "stat_stops": share(left(r"[^.?]+"), n),
        "stat_commas": share(left(r"[^,;:]+"), n),
        "stat_shouts": share(left("[^!]+"), n),
        "stat_symbols": share(left(r"[^#$%&*+/<=>@\\^_`{|}~-]+"), n),
    }


def with_statistics(docs: DataFrame, *keep: Column) -> DataFrame:
    """docs' columns in keep, and the statistics of its texts."""
    found = docs.select(*keep, text_of().alias("_text"))
    found = found.withColumns({"_w": F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)), "_l": F.filter(F.split("_text", "\n"), lambda x: x != "")})
    return found.withColumns(statistics(F.col("_text"))).drop("_text", "_w", "_l")


@dataclass
class Ensemble:
    """Rules over named statistics; the score is the logistic function of the bias and the weights of those that hold."""

    names: list[str]
    bias: float
    rules: list[tuple[Rule, float]]

    def column(self) -> Column:
        z = F.lit(float(self.bias))
        for rule, weight in self.rules:
            z += F.when(holds(rule, self.names), F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def holds(rule: Rule, names: list[str]) -> Column:
    out = F.lit(True)
    for at, above, limit in rule:
        out &= F.col(names[at]) > F.lit(limit) if above else F.col(names[at]) <= F.lit(limit)
    return out


def matches(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for at, above, limit in rule:
        out &= (x[:, at] > limit) == above
    return out


def limits(x: np.ndarray) -> list[np.ndarray]:
    """Thresholds between neighbouring values at BINS quantiles of each statistic."""
    out = []
    for column in x.T:
        values = np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1), method="nearest"))
        out.append((values[1:] + values[:-1]) / 2)
    return out


def grow(binned: np.ndarray, cuts: list[np.ndarray], slope: np.ndarray, curve: np.ndarray, least: int) -> list[tuple[list[tuple[int, bool, int]], np.ndarray, float]]:
    """A tree on the slopes of the loss: (path, rows, step) of each node but the root, leaves last in their branch."""
    nodes, todo = [], [([], np.arange(len(binned)))]
    while todo:
        path, rows = todo.pop()
        if path:
            nodes.append((path, rows, float(-slope[rows].sum() / (curve[rows].sum() + 1.0))))
        if len(path) == DEPTH:
            continue
        best, whole = (1e-9, 0, 0), slope[rows].sum() ** 2 / (curve[rows].sum() + 1.0)
        for at, cut in enumerate(cuts):
            if not len(cut):
                continue
            g, h, n = (np.cumsum(np.bincount(binned[rows, at], weights=w, minlength=len(cut) + 1))[:-1] for w in (slope[rows], curve[rows], np.ones(len(rows))))
            gain = g**2 / (h + 1.0) + (slope[rows].sum() - g) ** 2 / (curve[rows].sum() - h + 1.0) - whole
            gain[(n < least) | (len(rows) - n < least)] = 0
            if gain.max() > best[0]:
                best = (float(gain.max()), at, int(gain.argmax()))
        if best[0] > 1e-9:
            _, at, cut = best
            low = binned[rows, at] <= cut
            todo += [([*path, (at, False, cut)], rows[low]), ([*path, (at, True, cut)], rows[~low])]
    return nodes


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, rate: float = 0.2, seed: int = 3) -> list[Rule]:
    """The paths to all nodes of boosted trees, each grown on half the rows, as conjunctions; each once, at most one bound a side of a statistic."""
    cuts = limits(x)
    binned = np.stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T)], axis=1)
    rng, z, found = np.random.default_rng(seed), np.full(len(x), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(trees):
        some = np.sort(rng.permutation(len(x))[: max(2, len(x) // 2)])
        p = 1 / (1 + np.exp(-z))
        # rows of rows: what a node holds of the half that the tree is grown on
        for path, _, step in grow(binned[some], cuts, (p - y)[some], (p * (1 - p))[some], max(2, len(some) // 200)):
            bounds: dict[tuple[int, bool], int] = {}
            for at, above, cut in path:
                old = bounds.get((at, above), cut)
                bounds[at, above] = max(old, cut) if above else min(old, cut)
            rule = tuple((at, above, float(cuts[at][cut])) for (at, above), cut in sorted(bounds.items()))
            found[rule] = None
            if len(path) == DEPTH:
                z = z + rate * step * matches(rule, x)
    return list(found)


def lasso(x: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray | None = None, rounds: int = 300) -> np.ndarray:
    """Bias and weights that minimise mean log loss + penalty * sum of absolute weights (not the bias), by accelerated proximal steps."""
    n, m = x.shape
    w = np.zeros(m + 1) if start is None else start.copy()
    ahead, pace = w.copy(), 1.0
    # the largest eigenvalue of x'x / n by power steps, which bounds the curvature
    v = np.ones(m + 1) / np.sqrt(m + 1)
    for _ in range(30):
        v = np.concatenate([[0.0], x.T @ (x @ v[1:] + v[0])]) + np.concatenate([[(x @ v[1:] + v[0]).sum()], np.zeros(m)])
        top = np.linalg.norm(v)
        v = v / top
    step = 3.6 * n / top
    for _ in range(rounds):
        error = (1 / (1 + np.exp(-(x @ ahead[1:] + ahead[0]))) - y) / n
        new = ahead - step * np.concatenate([[error.sum()], x.T @ error])
        new[1:] = np.sign(new[1:]) * np.maximum(0, np.abs(new[1:]) - step * penalty)
        if (ahead - new) @ (new - w) > 0:  # the momentum leads uphill
            pace = 1.0
        faster = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        ahead, w, pace = new + (pace - 1) / faster * (new - w), new, faster
    return w


def log_loss(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    z = x @ w[1:] + w[0]
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit(x: np.ndarray, y: np.ndarray, names: list[str], steps: int = 12) -> Ensemble:
    """Rules from the trees, weights by the lasso; the penalty is that which predicts every fourth row best from the others."""
    if y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Ensemble(names, float(np.log(share / (1 - share))), [])
    rules = tree_rules(x, y)
    if not rules:
        return Ensemble(names, float(np.log(y.mean() / (1 - y.mean()))), [])
    on = np.stack([matches(r, x) for r in rules], axis=1).astype(np.float64)
    kept = np.arange(len(y)) % 4 > 0
    whole = np.abs(on.T @ (y - y.mean())).max() / len(y)
    best, w, at = (np.inf, whole), None, None
    if kept.any() and not kept.all():
        for penalty in whole * np.geomspace(0.5, 0.001, steps):
            w = lasso(on[kept], y[kept], penalty, w, 100)
            loss = log_loss(on[~kept], y[~kept], w)
            if loss < best[0] - 1e-4:
                best = (loss, penalty)
    at = lasso(on, y, best[1], rounds=600)
    return Ensemble(names, float(at[0]), [(r, float(v)) for r, v in zip(rules, at[1:]) if v])


def train(docs: DataFrame, labels: DataFrame, rows: int = 8000, seed: int = 13) -> Ensemble:
    """Fit on the statistics of about `rows` labelled documents (whole texts; chosen by a hash of doc_id).

    Rows whose crc32(doc_id as text) mod 5 is 0, and those without a doc_id, are never used. A doc_id with several
    labels has the one that most say (0 on a tie), one with several texts counts once. Without labels all scores are one half.
    """
    told = labels.filter(F.col("quality").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    told = told.groupBy("doc_id").agg((F.avg("quality") > 0.5).cast("int").alias("_label"))
    n = told.count()
    unit = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_003)) / 1_000_003
    # about `rows` of them: they go to all texts
    told = F.broadcast(told.filter(unit < min(1.0, rows / max(1, n))).withColumnRenamed("doc_id", "_of"))
    names = list(statistics(text_of()))
    found = with_statistics(docs.join(told, docs["doc_id"] == told["_of"]).select("_of", "_label", "text"), F.col("_of"), F.col("_label"))
    got = found.groupBy("_of").agg(F.min(F.struct("_label", *names)).alias("_s")).orderBy("_of").select("_s.*").collect()
    if not got:
        return Ensemble(names, 0.0, [])
    x = np.array([[r[k] for k in names] for r in got], dtype=np.float64)
    return fit(x, np.array([r["_label"] for r in got], dtype=np.float64), names)


def score_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = 8000, least: float = 0.3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text, and the columns in keep (under other names than those).

    score is how likely label 1 is, from the text's statistics only; predicted is 1 where it is `least` or more. Null
    texts are scored as empty ones, texts of any length whole; repeated rows give a row each, rows without a doc_id
    are scored and not held out, an empty table gives none; columns of other names are not read.
    """
    model = train(docs, labels, rows)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    row = F.struct("doc_id", held.alias("held_out"), *keep).alias("_row")
    scored = with_statistics(docs, row).select("_row", model.column().alias("score"))
    return scored.select("_row.doc_id", "_row.held_out", "score", (F.col("score") >= least).cast("int").alias("predicted"), *(F.col("_row")[c].alias(c) for c in keep))
