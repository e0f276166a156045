"""Text quality by a sparse ensemble of rules.

Trees grown on statistics of labelled texts give paths; each path is a
conjunction of comparisons.  A logistic regression with a lasso weighs the
rules, and those with a weight are compiled into one Spark column expression
over the statistics, which are Spark expressions themselves.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out

#: Labelled rows that a model is fitted on at most: those whose ids hash lowest.
ROWS = 20_000
TREES, DEPTH, LEAF, BINS = 24, 3, 5, 64
LASSO, ROUNDS = 1e-3, 500

Rule = tuple[tuple[str, bool, float], ...]  # (statistic, above?, threshold), all to hold


def _letters(text: Column, chars: str) -> Column:
    """How many characters of text are in a class of characters."""
    return F.regexp_count(text, F.lit(chars)).cast("double")


def statistics(text: Column) -> dict[str, Column]:
    """The statistics by name, of a text that isn't null.  All are finite; those of an empty text are 0."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    over = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    n, chars = F.size(words), F.char_length(text)
    return {
        "words": F.log1p(n.cast("double")),
        "word_length": over(chars, n),
        "distinct": over(F.size(F.array_distinct(words)), n),
        "repeats": over(n - F.size(F.array_distinct(words)), F.log1p(n.cast("double"))),
        "upper": over(_letters(text, r"\p{Lu}"), chars),
        "marks": over(_letters(text, r"[#$%&*|@<>{}\[\]=~^_\\+]"), chars),
        "bangs": over(_letters(text, r"[!?]"), n),
        "digits": over(_letters(text, "[0-9]"), chars),
        "stops": over(_letters(text, r"[.]"), n),
        "commas": over(_letters(text, "[,;:]"), n),
        "line_words": over(n, F.size(lines)),
        "line_repeats": over(F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines)),
        "doubled": over(_letters(text, r"(?<![^\s])(\S+)\s(?=\1(?!\S))"), n),
    }


@dataclass(frozen=True)
class Model:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self, stats: dict[str, Column]) -> Column:
        """The score, from 0 to 1, as an expression over columns by name."""

        def holds(rule: Rule) -> Column:
            return reduce(lambda a, b: a & b, [stats[name] > t if above else stats[name] <= t for name, above, t in rule])

        total = F.lit(self.bias)
        for rule, weight in self.rules:
            total = total + F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _grow(bins: np.ndarray, edges: list[np.ndarray], target: np.ndarray, names: list[str], usable: np.ndarray) -> list[Rule]:
    """The paths to all nodes of a least-squares tree, the root left out."""
    rules: list[Rule] = []

    def split(rows: np.ndarray, path: Rule, depth: int) -> None:
        if depth == DEPTH or len(rows) < 2 * LEAF:
            return
        best = (1e-9, 0, 0)
        y = target[rows]
        total, n = y.sum(), len(rows)
        for j in usable:
            b = bins[rows, j]
            count, summed = np.bincount(b, minlength=BINS + 1).cumsum()[:-1], np.bincount(b, weights=y, minlength=BINS + 1).cumsum()[:-1]
            fit = (count >= LEAF) & (n - count >= LEAF)
            if fit.any():
                gain = np.where(fit, summed**2 / np.maximum(count, 1) + (total - summed) ** 2 / np.maximum(n - count, 1) - total**2 / n, -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, k)
        if best[0] <= 1e-9:
            return
        _, j, k = best
        below = bins[rows, j] <= k
        for own, above in ((rows[below], False), (rows[~below], True)):
            rule = (*path, (names[j], above, float(edges[j][k])))
            rules.append(rule)
            split(own, rule, depth + 1)

    split(np.arange(len(target)), (), 0)
    return rules


def _hold(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    return np.logical_and.reduce([x[name] > t if above else x[name] <= t for name, above, t in rule])


def fit(stats: dict[str, np.ndarray], y: np.ndarray) -> Model:
    """Trees on the residuals of those before them; then a lasso over all their paths."""
    n = len(y)
    if not n or y.min() == y.max():
        return Model(float(4 * (2 * y.mean() - 1)) if n else 0.0, ())
    names = list(stats)
    x = np.column_stack([stats[k] for k in names])
    # midpoints between the values at evenly spaced ranks
    edges, bins = [], np.empty(x.shape, dtype=np.int64)
    for j in range(x.shape[1]):
        own = np.unique(x[:, j])
        at = np.unique(np.linspace(0, len(own) - 1, min(BINS, len(own))).astype(int))
        edges.append((own[at[:-1]] + own[at[1:]]) / 2 if len(at) > 1 else np.array([own[0]]))
        bins[:, j] = np.searchsorted(edges[j], x[:, j], "left")
    rules: dict[Rule, None] = {}
    score = np.full(n, math.log(y.mean() / (1 - y.mean())))
    rng = np.random.default_rng(0)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        usable = rng.permutation(len(names))[: max(3, len(names) * 2 // 3)]
        paths = _grow(bins, edges, y - p, names, np.sort(usable))
        rules.update(dict.fromkeys(paths))
        longer = {path[:-1] for path in paths}
        for path in (r for r in paths if r not in longer):
            own = _hold(path, stats)
            score[own] += 0.5 * np.clip((y - p)[own].sum() / max((p * (1 - p))[own].sum(), 1e-3), -4, 4)
    kept = list(rules)
    h = np.column_stack([_hold(r, stats) for r in kept]).astype(float) if kept else np.zeros((n, 0))
    # accelerated proximal gradient
    b0 = math.log(y.mean() / (1 - y.mean()))
    w, b, v, c, t = np.zeros(len(kept)), b0, np.zeros(len(kept)), b0, 1.0
    z = np.ones(len(kept) + 1)
    full = np.column_stack([h, np.ones(n)])
    top = 1.0
    for _ in range(30):
        z = full.T @ (full @ z)
        top = float(np.linalg.norm(z))
        z /= top
    step = 4 * n / (top * 1.05)
    for _ in range(ROUNDS):
        error = (1 / (1 + np.exp(-(h @ v + c))) - y) / n
        new, new_b = v - step * (h.T @ error), c - step * error.sum()
        new = np.sign(new) * np.maximum(np.abs(new) - step * LASSO, 0)
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / after * (new - w), new_b + (t - 1) / after * (new_b - b)
        w, b, t = new, new_b, after
    return Model(float(b), tuple((r, float(k)) for r, k in zip(kept, w) if k))


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs' ``doc_id`` and a column ``s`` of the statistics of its whole text (null: as empty)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.struct(*(c.alias(k) for k, c in statistics(text).items())).alias("s"))


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents that aren't held out; only their statistics come to the driver.

    Of an id's labels the least counts, and of its rows the least text.
    """
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    chosen = chosen.select(F.col("doc_id").alias("_pw_id"), F.col("quality").cast("int").alias("_pw_y")).groupBy("_pw_id").agg(F.min("_pw_y").alias("_pw_y"))
    chosen = chosen.orderBy(F.xxhash64("_pw_id"), "_pw_id").limit(rows)
    own = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_pw_id"))  # at most ``rows`` ids
    # one text an id, however often it is there
    own = own.groupBy("doc_id").agg(F.min("_pw_y").alias("_pw_y"), F.min("text").alias("text"))
    found = own.select("doc_id", "_pw_y", *(c.alias(k) for k, c in statistics(F.col("text")).items())).toPandas().sort_values("doc_id")
    return fit({k: found[k].to_numpy(dtype=float) for k in found.columns[2:]}, found["_pw_y"].to_numpy(dtype=float))


def quality(docs: DataFrame, labels: DataFrame, limit: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of docs.

    Labels of the held-out fifth are never read.  Without labels of both kinds
    all texts score alike; null and empty texts score as texts without words;
    rows with null ids are scored and not held out; repeated rows score alike;
    very long texts are read whole; scores that tie with limit are predicted 1;
    an empty table gives no rows; other columns are ignored.
    """
    model = train(docs, labels)
    scored = with_statistics(docs)
    score = model.column({k: F.col(f"s.{k}") for k in statistics(F.lit(""))})
    out = scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= limit).cast("int"))
