"""Toxicity by a sparse linear model with counterfactual regularisation.

Features of a text are its words, and how many of its distinct words share a
beginning.  The
model is a logistic regression with a lasso; for each labelled text that names
a group, copies with another group's name in its place are made, and the squared
change of the score is part of the loss, so that a group's mere mention weighs
nothing of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, table

#: Labelled rows that a model is fitted on at most (those whose ids hash lowest), and words of them that it may weigh.
ROWS, FEATURES = 12_000, 4_000
#: A feature in fewer labelled texts than 2, or than one in so many of them, has no weight.
LEAST = 800
#: So has one in a larger share of them.
COMMON = 0.9
LASSO, RIDGE, COUNTERFACTUAL, ROUNDS = 1e-4, 1e-5, 1.0, 600

#: Group names that may stand for one another, as fixed values.
IDENTITIES = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "african", "european", "latino", "arab"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrant", "native", "refugee", "foreigner"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("disabled", "blind", "deaf", "elderly", "young"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)
_GROUP = {name: group for group in IDENTITIES for name in group}
#: Lengths of the beginnings that are features beside the whole word.
STEMS = (4, 5, 6, 7, 8)
#: Numbers of distinct words with one beginning from which there is a further feature.
LEVELS = (2, 3, 5)

_WORDS = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """A word, and its beginnings (marked by *) where it goes on behind them; group names have no beginnings."""
    if word in _GROUP:
        return [word]
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


def distinct_words(text: str | None) -> set[str]:
    return set(_WORDS.findall((text or "").lower()))


def levels(counts: dict[str, int]) -> set[str]:
    """The features of a text, from how many of its distinct words have each; ``#k``: k or more."""
    return {*counts, *(f"{x}#{k}" for x, n in counts.items() if n >= LEVELS[0] for k in LEVELS if n >= k)}


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float]

    @cached_property
    def bases(self) -> set[str]:
        """Words and beginnings with a weight at any level."""
        return {x.partition("#")[0] for x in self.weights}

    def word(self, word: str) -> tuple[str, ...]:
        return tuple(x for x in features(word) if x in self.bases)

    def score(self, text: str | None, memo: dict[str, tuple[str, ...]]) -> float:
        """From 0 to 1.  memo keeps what words hold; the caller bounds it."""
        found: dict[str, int] = {}
        for word in distinct_words(text):
            if (own := memo.get(word)) is None:
                own = memo[word] = self.word(word)
            for x in own:
                found[x] = found.get(x, 0) + 1
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(self.weights.get(x, 0.0) for x in sorted(levels(found))), -40, 40))))


def document_features(words: set[str]) -> set[str]:
    counts: dict[str, int] = {}
    for word in words:
        for x in features(word):
            counts[x] = counts.get(x, 0) + 1
    return levels(counts)


def solve(row: np.ndarray, column: np.ndarray, k: int, y: np.ndarray, gain: np.ndarray, loss: np.ndarray) -> tuple[float, np.ndarray]:
    """Bias and weights of k features, of which document ``row[i]`` has ``column[i]``.

    In a counterfactual pair a text's feature ``loss[i]`` becomes ``gain[i]`` (-1:
    a name without a weight).  Accelerated proximal gradient steps.
    """
    m, base = len(y), y.mean()
    start = float(np.log(base / (1 - base)))
    w, b, t, v, c = np.zeros(k), start, 1.0, np.zeros(k), start
    x, top = np.ones(k), 1.0  # a bound of the curvature, by power steps
    for _ in range(20 if k else 0):
        x = np.bincount(column, weights=np.bincount(row, weights=x[column], minlength=m)[row], minlength=k)
        top = max(float(np.linalg.norm(x)), 1e-9)
        x /= top
    step = 1 / (top / 4 / m + 0.25 + RIDGE + 4 * COUNTERFACTUAL * max(1, len(gain)) / m)
    gain, loss = np.where(gain < 0, k, gain), np.where(loss < 0, k, loss)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-(c + np.bincount(row, weights=v[column], minlength=m))))
        error = (p - y) / m
        grad = np.bincount(column, weights=error[row], minlength=k) + RIDGE * v
        if len(gain):
            padded = np.append(v, 0.0)
            change = (padded[gain] - padded[loss]) * 2 * COUNTERFACTUAL / m
            grad += (np.bincount(gain, weights=change, minlength=k + 1) - np.bincount(loss, weights=change, minlength=k + 1))[:k]
        new, new_b = v - step * grad, c - step * error.sum()
        new = np.sign(new) * np.maximum(np.abs(new) - step * LASSO, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / after * (new - w), new_b + (t - 1) / after * (new_b - b)
        w, b, t = new, new_b, after
    return float(b), w


def swaps(words: set[str]) -> list[tuple[str, str]]:
    """``(there, instead)`` for each group name of a text and each other of its kind that isn't in it."""
    return [(word, other) for word in sorted(words & _GROUP.keys()) for other in _GROUP[word] if other not in words]


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS, most: int = FEATURES, least: int | None = None, common: float = COMMON) -> Model:
    """Fit on at most ``rows`` labelled documents that aren't held out.

    Features are counted where the documents are; the driver gets the ``most``
    telling of those that ``least`` labelled texts and no larger share than
    ``common`` have, and which of them each document has.  An id that is labelled
    twice is toxic only if both say so, and of its rows the least text counts.
    """
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    chosen = chosen.select(F.col("doc_id").alias("_pw_id"), (F.col("toxic") > 0).cast("int").alias("_pw_y")).groupBy("_pw_id").agg(F.min("_pw_y").alias("_pw_y"))
    chosen = chosen.orderBy(F.xxhash64("_pw_id"), "_pw_id").limit(rows)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_pw_id"))  # at most ``rows`` ids

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [" ".join(sorted(distinct_words(x.as_py()))) for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(words, pa.string())], names=["y", "words"])

    texts = texts.groupBy("_pw_id").agg(F.min("_pw_y").alias("_pw_y"), F.min("text").alias("text"))
    texts = table(texts.select("_pw_y", "text").mapInArrow(split, "y int, words string"), "labelled")
    total, positive = texts.agg(F.count("*"), F.sum("y")).first()
    if not total or positive in (0, total):
        return Model(float(4 * (2 * positive / total - 1)) if total else -4.0, {})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[dict[str, int], dict[str, int]] = ({}, {})

        def full(size: int) -> Iterator[pa.RecordBatch]:
            """Counts so far; those of one feature are summed later, so that memory stays bounded."""
            for y, own in enumerate(seen):
                if len(own) > size:
                    counts = np.fromiter(own.values(), np.int64, len(own))
                    yield pa.record_batch([pa.array(list(own), pa.string()), pa.array(counts), pa.array(counts * y)], names=["feature", "n", "n1"])
                    own.clear()

        for batch in batches:
            for y, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = seen[y]
                for x in document_features(set(words.as_py().split())):
                    own[x] = own.get(x, 0) + 1
                yield from full(100_000)
        yield from full(0)

    base, least = positive / total, max(2, total // LEAST) if least is None else least
    counts = texts.mapInArrow(count, "feature string, n bigint, n1 bigint").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))
    z = F.abs(F.col("n1") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base))
    named = F.col("feature").isin(list(_GROUP))
    best = counts.where((F.col("n") >= least) & (named | (F.col("n") <= common * total))).orderBy(F.desc(named), F.desc(z), "feature").limit(most)
    names = sorted(r["feature"] for r in best.select("feature").collect())  # at most ``most``
    shared = docs.sparkSession.sparkContext.broadcast({x: k for k, x in enumerate(names)})

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        for batch in batches:
            have, gain, loss = [], [], []
            for words in (set(x.as_py().split()) for x in batch.column(1)):
                have.append(sorted(place[x] for x in document_features(words) if x in place))
                pairs = swaps(words)
                gain.append([place.get(b, -1) for _, b in pairs])
                loss.append([place.get(a, -1) for a, _ in pairs])
            kind = pa.list_(pa.int32())
            yield pa.record_batch([batch.column(0), pa.array(have, kind), pa.array(gain, kind), pa.array(loss, kind)], names=["y", "have", "gain", "loss"])

    found = texts.mapInArrow(index, "y int, have array<int>, gain array<int>, loss array<int>").toArrow()  # at most ``rows`` rows of numbers
    flat = lambda name: found.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.array([len(x) for x in found.column("have")], dtype=np.int64)
    y = found.column("y").to_numpy().astype(float)
    bias, weights = solve(np.repeat(np.arange(len(y)), sizes), flat("have"), len(names), y, flat("gain"), flat("loss"))
    return Model(bias, {names[j]: float(x) for j, x in enumerate(weights) if x})


def _memo_score(model: Model, memo: dict, texts: Iterator) -> list[float]:
    out = []
    for text in texts:
        if len(memo) > 100_000:
            memo.clear()
        out.append(model.score(text, memo))
    return out


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` for each row; null and empty texts have the score of a text without words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            found = _memo_score(shared.value, memo, (x.as_py() for x in batch.column(1)))
            yield pa.record_batch([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {ids}, score double")


def clean(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows of docs that score below limit, with all their columns; null and empty texts score as without words, very long ones whole."""
    at, shared = docs.columns.index("text"), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            found = _memo_score(shared.value, memo, (x.as_py() for x in batch.column(at)))
            yield batch.filter(pa.array([x < limit for x in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of docs.

    Labels of the held-out fifth are never read.  Without labels of both kinds
    all texts score alike; rows with null ids are scored and not held out;
    repeated rows score alike; very long texts are read whole; scores that tie
    with limit are predicted 1; an empty table gives no rows; other columns are
    ignored.
    """
    out = scores(docs, train(docs, labels))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))
