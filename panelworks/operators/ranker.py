"""A pooled regression-tree ranker on causal features, with selection by validation RankIC.

Spark ML's boosted trees stand in for the boosting library that the protocol
names; it is another learner, so its scores are not comparable with that one's.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evaluate, panel

#: ``(depth, rounds)`` of the candidates, the simplest first; at most 12.
CANDIDATES = ((2, 4), (2, 8), (3, 4))


def frame(bars: DataFrame, *splits: str) -> DataFrame:
    """``origin, ticker, features, label, label_end, split`` of rows whose features are all there; split is null between the splits."""
    features = panel.causal_features(bars)
    names = [c for c in features.columns if c not in ("session", "ticker")]
    labels = panel.assign_split(panel.forward_label(bars), *splits).select("session", "ticker", "label", "label_end", "split")
    rows = features.dropna().join(labels, ["session", "ticker"])
    return VectorAssembler(inputCols=names, outputCol="features").transform(rows).select(F.col("session").alias("origin"), "ticker", "features", "label", "label_end", "split")


def refit_rows(rows: DataFrame, *splits: str) -> DataFrame:
    """The rows of frame() that the last fit sees: all whose labels end by the end of validation, whatever their split."""
    return rows.where(F.col("label_end") <= F.lit(splits[2]).cast("date"))


def fit(train: DataFrame, depth: int, rounds: int, seed: int = 42):
    return GBTRegressor(featuresCol="features", labelCol="label", predictionCol="score", maxDepth=depth, maxIter=rounds, lossType="absolute", seed=seed).fit(train)


def search(bars: DataFrame, *splits: str, candidates=CANDIDATES) -> DataFrame:
    """``depth, rounds, dates, rank_ic, place``: every candidate, fitted on development alone; ties go to the simpler."""
    if len(candidates) > 12:
        raise ValueError("at most 12 candidates")
    rows = frame(bars, *splits).where("split IS NOT NULL").persist()
    try:
        train, valid = rows.where("split = 'development'"), rows.where("split = 'validation'")
        found = []
        for depth, rounds in candidates:
            if train.isEmpty():
                break
            scored = fit(train, depth, rounds).transform(valid).select("origin", "ticker", "score", "label")
            best = evaluate.rank_ic_mean(evaluate.rank_ic_daily(scored)).first()
            found.append((depth, rounds, best["dates"], best["mean_rank_ic"]))
    finally:
        rows.unpersist()
    found.sort(key=lambda x: (-(x[3] if x[3] is not None else float("-inf")), x[0] * x[1], x[0]))
    spark = bars.sparkSession
    return spark.createDataFrame([(*x, k + 1) for k, x in enumerate(found)], "depth int, rounds int, dates bigint, rank_ic double, place int")


def refit(bars: DataFrame, *splits: str, depth: int, rounds: int) -> DataFrame:
    """``origin, ticker, score`` of the test rows, by the chosen candidate fitted once on all labels that end before."""
    rows = frame(bars, *splits)
    model = fit(refit_rows(rows, *splits), depth, rounds)
    return model.transform(rows.where("split = 'test'")).select("origin", "ticker", "score")
