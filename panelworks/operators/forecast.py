"""Forecast requests, the rules they obey, and a pluggable predictor behind Arrow.

A request is one row: a ticker's last 90 completed bars and ten future dates.
Requests of one logical shard are one batch to the predictor, so that seeds and
batch composition don't depend on how Spark deals rows out.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, let
from ..functions.identity import SEED_TAG, SHARD_TAG, effective_seed_column, shard_identities
from .panel import CONTEXT, HORIZON


class ContractError(ValueError):
    """A request, configuration or prediction breaks the forecast contract."""


class ShardError(ValueError):
    """A shard of predictions breaks its rules."""


#: What ``amount_source`` may say, as fixed values.
AMOUNT_GIVEN, AMOUNT_ESTIMATED = "source_provided", "estimated_ohlcv_proxy_by_official_predictor"
#: Column names, in lower case, that hold what a forecast must not see: fixed values.
FORBIDDEN = frozenset({"label", "labels", "target", "targets", "actual", "actual_y", "realized", "y"})

PREDICTION_SCHEMA = (
    "model string, seed int, ticker string, origin timestamp_ntz, horizon int, input_end timestamp_ntz, forecast_date timestamp_ntz, "
    "predicted_close double, current_close double, score double, split string, logical_shard_id string, effective_seed bigint, "
    "model_id string, model_revision string, tokenizer_id string, tokenizer_revision string, implementation_revision string, "
    "temperature double, top_p double, top_k int, sample_count int, amount_source string, output_semantics string, batch_elapsed_seconds double"
)
PREDICTION_COLUMNS = [x.split()[0] for x in PREDICTION_SCHEMA.split(", ")]
KEY = ["model", "seed", "ticker", "origin", "horizon"]


@dataclass(frozen=True)
class ForecastConfig:
    """What every row of a run says about its model; sampling settings are fixed and may not drift."""

    model: str = "surrogate-drift"
    model_id: str = "surrogate-drift"
    tokenizer_id: str = "none"
    output_semantics: str = "mean_of_sampled_paths"
    model_revision: str = "0" * 40
    tokenizer_revision: str = "0" * 40
    implementation_revision: str = "0" * 40
    seed: int = 42
    context: int = CONTEXT
    horizon: int = HORIZON
    temperature: float = 0.6
    top_p: float = 0.9
    top_k: int = 0
    sample_count: int = 10
    shard_tag: str = field(default=SHARD_TAG)
    seed_tag: str = field(default=SEED_TAG)

    def __post_init__(self):
        fixed = dict(context=CONTEXT, horizon=HORIZON, temperature=0.6, top_p=0.9, top_k=0, sample_count=10)
        if wrong := [k for k, v in fixed.items() if getattr(self, k) != v]:
            raise ContractError(f"fixed by the protocol: {', '.join(wrong)}")
        if self.seed < 0:
            raise ContractError("seed is negative")
        for name in ("model_revision", "tokenizer_revision", "implementation_revision"):
            if not re.fullmatch("[0-9a-f]{40}", getattr(self, name)):
                raise ContractError(f"{name} is no 40-digit lower-case hex revision")


class Predictor(Protocol):
    """Frames of bars and their dates in, one frame with ``close`` at the asked dates out for each."""

    def predict_batch(self, frames: list[pd.DataFrame], dates: list[pd.DatetimeIndex], future: list[pd.DatetimeIndex], config: ForecastConfig) -> list[pd.DataFrame]: ...


class DriftPredictor:
    """A surrogate for a forecasting model: the context's mean return goes on."""

    def predict_batch(self, frames, dates, future, config):
        out = []
        for frame, ahead in zip(frames, future):
            close = frame["close"].to_numpy()
            drift = float(np.mean(close[1:] / close[:-1] - 1))
            out.append(pd.DataFrame({"close": close[-1] * np.maximum(1 + np.arange(1, len(ahead) + 1) * drift, 1e-6)}, index=ahead))
        return out


def seed_everything(seed: int) -> None:
    """Seed Python's, NumPy's and, where it is there, torch's generators of this worker."""
    import random
    import sys

    random.seed(seed)
    np.random.seed(seed % 2**32)
    if torch := sys.modules.get("torch"):
        torch.manual_seed(seed)
        if torch.cuda.is_available() and torch.cuda.is_initialized():
            torch.cuda.manual_seed_all(seed)


def freeze(module) -> None:
    """Evaluation mode and no gradients; what can't be frozen raises."""
    if not hasattr(module, "eval") or not (hasattr(module, "requires_grad_") or hasattr(module, "parameters")):
        raise ContractError("the model can't be frozen")
    module.eval()
    if hasattr(module, "requires_grad_"):
        module.requires_grad_(False)
    else:
        for p in module.parameters():
            p.requires_grad = False


def requests(bars: DataFrame, future_dates: Column | None = None, context: int = CONTEXT, horizon: int = HORIZON) -> DataFrame:
    """``ticker, origin, history, history_dates, forecast_dates`` for each bar with a whole context.

    Bars without volume or with extra columns are cut to open, high, low, close,
    volume (and amount, if there is one): nothing else reaches a model.  Forecast
    dates are weekly steps from the origin unless given.
    """
    names = [c for c in ("open", "high", "low", "close", "volume", "amount") if c in bars.columns]
    w = Window.partitionBy("ticker").orderBy("session").rowsBetween(1 - context, 0)
    bars = bars.withColumn("session", F.col("session").cast("timestamp_ntz"))
    out = bars.select(
        "ticker",
        F.col("session").alias("origin"),
        F.collect_list(F.struct(*(F.col(c).cast("double").alias(c) for c in names))).over(w).alias("history"),
        F.collect_list("session").over(w).alias("history_dates"),
    ).where(F.size("history") == context)
    ahead = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda k: (F.date_add(F.col("origin").cast("date"), k * 7)).cast("timestamp_ntz"))
    return out.withColumn("forecast_dates", future_dates if future_dates is not None else ahead)


def _increasing(dates: Column) -> Column:
    """No null among them, and each after the one before."""
    return ~F.exists(dates, lambda x: x.isNull()) & F.forall(F.sequence(F.lit(1), F.greatest(F.size(dates) - 1, F.lit(1))), lambda i: (i >= F.size(dates)) | (F.get(dates, i) > F.get(dates, i - 1)))


#: The rules of a request, by id, in the order in which they are looked at.
def request_rules(fields: list[str], context: int = CONTEXT, horizon: int = HORIZON) -> dict[str, Column]:
    h, past, ahead = F.col("history"), F.col("history_dates"), F.col("forecast_dates")
    prices = [c for c in ("open", "high", "low", "close") if c in fields]
    sizes = [c for c in ("volume", "amount") if c in fields]
    some = lambda test: F.exists(h, test)
    any_of = lambda x, names, test: F.array_contains(F.array(*(test(x[c]) for c in names)), True)
    return {
        "ticker": F.col("ticker").isNull() | (F.trim(F.col("ticker")) == ""),
        "history_size": F.size(h) != context,
        "history_order": ~_increasing(past),
        "history_dates_size": F.size(past) != context,
        "forecast_order": ~_increasing(ahead),
        "forecast_size": F.size(ahead) != horizon,
        "origin": ~F.col("origin").eqNullSafe(F.try_element_at(past, F.lit(-1))),
        "forecast_after_origin": F.coalesce(F.get(ahead, F.lit(0)) <= F.col("origin"), F.lit(True)),
        "finite": some(lambda x: any_of(x, prices + sizes, lambda v: ~finite(v))),
        "positive_prices": some(lambda x: any_of(x, prices, lambda v: v <= 0)),
        "non_negative_volume": some(lambda x: any_of(x, sizes, lambda v: v < 0)),
    }


def request_violations(rows: DataFrame, context: int = CONTEXT, horizon: int = HORIZON) -> DataFrame:
    """``ticker, origin, rule`` for each rule that a request breaks, and ``duplicate`` for keys that repeat."""
    kind = rows.schema["history"].dataType
    fields = kind.elementType.names
    if missing := [c for c in ("open", "high", "low", "close", "volume") if c not in fields]:
        raise ContractError(f"history lacks {', '.join(missing)}")
    named = F.array(*(F.when(F.coalesce(test, F.lit(True)), F.lit(name)) for name, test in request_rules(fields, context, horizon).items()))
    broken = rows.select("ticker", "origin", F.explode(F.array_compact(named)).alias("rule"))
    twice = rows.groupBy("ticker", "origin").count().where("count > 1").select("ticker", "origin", F.lit("duplicate").alias("rule"))
    return broken.unionByName(twice)


def check_requests(rows: DataFrame, context: int = CONTEXT, horizon: int = HORIZON) -> None:
    if found := request_violations(rows, context, horizon).limit(5).collect():
        raise ContractError("; ".join(f"{r['ticker']} {r['origin']}: {r['rule']}" for r in found))


def assign_shards(rows: DataFrame, split: str, config: ForecastConfig, size: int = 64) -> DataFrame:
    """Requests with ``logical_shard_id`` and ``effective_seed``: about ``size`` to a shard, by a hash of their key."""
    total = rows.count()
    shards = max(1, -(-total // size))
    rows = rows.withColumn("_shard", F.pmod(F.xxhash64("ticker", F.col("origin").cast("string")), F.lit(shards)))
    ids = shard_identities(rows.select("_shard", "ticker", "origin"), ["_shard"], F.lit(split), F.lit(config.seed), config.shard_tag)
    out = rows.join(ids, "_shard").drop("_shard").withColumn("split", F.lit(split))
    return out.withColumn("effective_seed", effective_seed_column(F.lit(config.seed), F.col("logical_shard_id"), config.seed_tag))


def predict(rows: DataFrame, predictor: Predictor, config: ForecastConfig, *, seed_setter: Callable[[int], None] = seed_everything, clock: Callable[[], float] = time.perf_counter) -> DataFrame:
    """The 25-column predictions, ten rows a request, of requests that have their shard.

    The predictor gets a shard's requests in the order of (origin, ticker), with
    prices and volumes alone.  What it returns must match in number, dates and
    range; otherwise ContractError fails the task.
    """
    fields = [c for c in ("open", "high", "low", "close", "volume", "amount") if c in rows.schema["history"].dataType.elementType.names]
    lean = rows.select("ticker", "origin", F.transform("history", lambda x: F.struct(*(x[c].alias(c) for c in fields))).alias("history"), "history_dates", "forecast_dates", "split", "logical_shard_id", "effective_seed")
    source = AMOUNT_GIVEN if "amount" in fields else AMOUNT_ESTIMATED

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.assign(_o=[pd.Timestamp(x).isoformat() for x in shard["origin"]]).sort_values(["_o", "ticker"], kind="stable")
        frames = [pd.DataFrame.from_records([x if isinstance(x, dict) else x.asDict() for x in h], columns=fields) for h in shard["history"]]
        past, ahead = ([pd.DatetimeIndex(x) for x in shard[c]] for c in ("history_dates", "forecast_dates"))
        seed_setter(int(shard["effective_seed"].iloc[0]))
        started = clock()
        made = predictor.predict_batch(frames, past, ahead, config)
        elapsed = clock() - started
        if len(made) != len(frames):
            raise ContractError("the predictor answered another number of requests")
        out = []
        for row, frame, dates, answer in zip(shard.itertuples(), frames, ahead, made):
            if not isinstance(answer, pd.DataFrame) or "close" not in answer or len(answer) != config.horizon:
                raise ContractError(f"{row.ticker}: no frame of {config.horizon} closes")
            if list(pd.DatetimeIndex(answer.index)) != list(dates):
                raise ContractError(f"{row.ticker}: dates differ from those asked")
            closes, now = answer["close"].to_numpy(dtype=float), float(frame["close"].iloc[-1])
            if not (np.isfinite(closes).all() and (closes > 0).all()):
                raise ContractError(f"{row.ticker}: closes must be finite and positive")
            score = float(closes.mean() / now - 1)
            if not np.isfinite(score):
                raise ContractError(f"{row.ticker}: the score isn't finite")
            said = dict(model=config.model, seed=config.seed, ticker=row.ticker, origin=row.origin, input_end=row.origin, current_close=now, score=score, split=row.split, logical_shard_id=row.logical_shard_id, effective_seed=row.effective_seed)
            said |= {k: getattr(config, k) for k in ("model_id", "model_revision", "tokenizer_id", "tokenizer_revision", "implementation_revision", "temperature", "top_p", "top_k", "sample_count", "output_semantics")}
            said |= dict(amount_source=source, batch_elapsed_seconds=elapsed)
            out += [said | dict(horizon=k + 1, forecast_date=d, predicted_close=float(c)) for k, (d, c) in enumerate(zip(dates, closes))]
        return pd.DataFrame(out, columns=PREDICTION_COLUMNS)

    return lean.groupBy("logical_shard_id").applyInPandas(run, PREDICTION_SCHEMA)


def as_predictions(long: DataFrame, split: str, config: ForecastConfig, by: list[str]) -> DataFrame:
    """The 25 columns for rows of ``ticker, origin, horizon, forecast_date, current_close, predicted_close, score``; a shard per value of ``by``."""
    keys = long.where("horizon = 1").select("ticker", "origin", *[c for c in by if c not in ("ticker", "origin")])
    ids = shard_identities(keys, by, F.lit(split), F.lit(config.seed), config.shard_tag)
    out = long.join(ids, by).withColumn("effective_seed", effective_seed_column(F.lit(config.seed), F.col("logical_shard_id"), config.seed_tag))
    said = ("model", "seed", "model_id", "model_revision", "tokenizer_id", "tokenizer_revision", "implementation_revision", "temperature", "top_p", "top_k", "sample_count", "output_semantics")
    out = out.withColumns({k: F.lit(getattr(config, k)) for k in said} | {"split": F.lit(split), "input_end": F.col("origin"), "amount_source": F.lit(AMOUNT_ESTIMATED), "batch_elapsed_seconds": F.lit(0.0)})
    return out.select(*PREDICTION_COLUMNS)


def drift_long(rows: DataFrame) -> DataFrame:
    """``ticker, origin, horizon, forecast_date, current_close, predicted_close, score``: the surrogate inside Catalyst."""

    def mean_step(closes: Column) -> Column:
        """One pass that carries the close before."""
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("last"))
        walk = F.aggregate(closes, start, lambda a, x: F.struct((a["sum"] + F.coalesce(x / a["last"] - 1, F.lit(0.0))).alias("sum"), x.alias("last")))
        return walk["sum"] / (F.size(closes) - 1)

    closes = let(F.transform("history", lambda x: x["close"]), lambda c: F.struct(F.try_element_at(c, F.lit(-1)).alias("current_close"), mean_step(c).alias("drift")))
    rows = rows.select("ticker", "origin", "forecast_dates", closes.alias("c")).select("ticker", "origin", "forecast_dates", "c.*")
    path = F.transform(F.sequence(F.lit(1), F.size("forecast_dates")), lambda k: F.col("current_close") * F.greatest(1 + k * F.col("drift"), F.lit(1e-6)))
    rows = rows.withColumn("path", path).withColumn("score", F.aggregate("path", F.lit(0.0), lambda a, x: a + x) / F.size("path") / F.col("current_close") - 1)
    each = rows.select("ticker", "origin", "current_close", "score", F.posexplode(F.arrays_zip("forecast_dates", "path")).alias("pos", "x"))
    return each.select("ticker", "origin", (F.col("pos") + 1).alias("horizon"), F.col("x.forecast_dates").alias("forecast_date"), "current_close", F.col("x.path").alias("predicted_close"), "score")
