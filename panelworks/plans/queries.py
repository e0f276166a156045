"""The registered queries over the driver's tables: thin compositions of the operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import wall_clock as wall
from ..functions.identity import effective_seed_column, shard_identities
from ..operators import evaluate, forecast, ledger, panel, predictions
from ..sources import shards, tables

Query = Callable[[SparkSession, str], DataFrame]

#: The reference's split boundaries fit other years; these are the same rules on the tables' years.
SPLITS = ("1995-12-31", "1996-07-01", "1996-12-31", "1997-01-01")
CONFIG = forecast.ForecastConfig()
COSTS = (ledger.Strategy("cost_00", cost_bps_per_side=0.0), ledger.Strategy("cost_05"), ledger.Strategy("cost_15", cost_bps_per_side=15.0))


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


def bars_weekly(spark, sf_dir):
    return tables.weekly_bars(spark, sf_dir).select("session", "ticker", "open", "high", "low", "close", "volume")


def bars_events_hourly(spark, sf_dir):
    return tables.hourly_bars(spark, sf_dir).select("session", "ticker", "open", "high", "low", "close", "volume")


def forward_label(spark, sf_dir):
    return panel.forward_label(tables.weekly_bars(spark, sf_dir)).select("session", "ticker", "label_end", _r("label"))


def forward_label_strict(spark, sf_dir):
    return panel.forward_label(tables.weekly_bars(spark, sf_dir), strict=True).where("label IS NOT NULL").select("session", "ticker", "label_end", _r("label"))


def label_end_split(spark, sf_dir):
    rows = panel.assign_split(panel.forward_label(tables.weekly_bars(spark, sf_dir)), *SPLITS)
    return rows.where("split IS NOT NULL").select("session", "ticker", "label_end", "split")


def context_complete_90(spark, sf_dir):
    rows = panel.context_complete(tables.weekly_bars(spark, sf_dir))
    return rows.select("session", "ticker", F.col("context_rows").cast("bigint").alias("context_rows"), "complete")


def turnover_proxy(spark, sf_dir):
    return panel.turnover_proxy(tables.weekly_bars(spark, sf_dir)).select("session", "ticker", "amount")


def causal_features(spark, sf_dir):
    names = ("return_1", "return_4", "to_mean_12", "spread_20", "place_20", "volume_20", "span")
    return panel.causal_features(tables.weekly_bars(spark, sf_dir)).select("session", "ticker", *(_r(c) for c in names))


def rank_average_ties(spark, sf_dir):
    rows = tables.weekly_bars(spark, sf_dir).withColumn("volume", F.floor(F.col("volume") / 20))
    return rows.select("session", "ticker", panel.average_rank(F.col("volume"), "session").alias("rank"))


def _scores(spark, sf_dir):
    return panel.momentum_scores(tables.weekly_bars(spark, sf_dir))


def _pairs(spark, sf_dir):
    labels = panel.forward_label(tables.weekly_bars(spark, sf_dir)).select(F.col("session").alias("origin"), "ticker", "label")
    return _scores(spark, sf_dir).join(labels, ["origin", "ticker"])


def rank_ic_daily(spark, sf_dir):
    return evaluate.rank_ic_daily(_pairs(spark, sf_dir)).select("origin", "n", _r("rank_ic"))


def rank_ic_mean(spark, sf_dir):
    return evaluate.rank_ic_mean(evaluate.rank_ic_daily(_pairs(spark, sf_dir))).select("dates", _r("mean_rank_ic"))


def _paired(spark, sf_dir):
    bars = tables.weekly_bars(spark, sf_dir)
    labels = panel.forward_label(bars).select(F.col("session").alias("origin"), "ticker", "label")
    return evaluate.paired_difference(evaluate.common(panel.momentum_scores(bars), panel.momentum_scores(bars, 12)).join(labels, ["origin", "ticker"]))


def rank_ic_paired(spark, sf_dir):
    """The daily difference of two scores' RankIC over the observations they share."""
    return _paired(spark, sf_dir).select("origin", "n", _r("difference"))


def mae_mean(spark, sf_dir):
    found = evaluate.mae_mean(evaluate.mae_daily(_pairs(spark, sf_dir)))
    return found.select("dates", _r("mean_mae"), _r("mean_mae_bps", 3), _r("mean_zero_mae"))


def mae_daily(spark, sf_dir):
    return evaluate.mae_daily(_pairs(spark, sf_dir)).select("origin", _r("mae"), _r("mae_bps", 3), _r("zero_mae"))


def coverage_daily(spark, sf_dir):
    expected = tables.weekly_bars(spark, sf_dir).select(F.col("session").alias("origin"), "ticker")
    return evaluate.coverage_daily(expected, _scores(spark, sf_dir)).select("origin", "expected", "scored", _r("coverage"), "enough")


def _interval(found: DataFrame) -> DataFrame:
    return found.select("block", F.col("dates").cast("bigint").alias("dates"), _r("mean"), _r("low"), _r("high"))


def bootstrap_ci(spark, sf_dir):
    return _interval(evaluate.block_bootstrap(evaluate.rank_ic_daily(_pairs(spark, sf_dir)), "rank_ic", (10, 20, 40)))


def bootstrap_paired(spark, sf_dir):
    """The headline statistic: the interval of the mean daily difference of two scores' RankIC."""
    return _interval(evaluate.block_bootstrap(_paired(spark, sf_dir), "difference", (10, 20, 40)))


def topk_by_origin(spark, sf_dir):
    return panel.top_k(_scores(spark, sf_dir), 5).select("origin", "ticker", _r("score"), F.col("rank").cast("bigint").alias("rank"))


def signal_next_session(spark, sf_dir):
    return panel.signal_sessions(tables.weekly_bars(spark, sf_dir))


def duplicate_keys(spark, sf_dir):
    return panel.duplicate_keys(tables.read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def shard_identity(spark, sf_dir):
    keys = tables.weekly_bars(spark, sf_dir).select("ticker", F.col("session").cast("timestamp_ntz").alias("origin"))
    return shard_identities(keys, ["ticker"], F.lit("validation"), F.lit(42))


def effective_seed(spark, sf_dir):
    return shard_identity(spark, sf_dir).withColumn("effective_seed", effective_seed_column(F.lit(42), F.col("logical_shard_id")))


def _requests(spark, sf_dir):
    return forecast.requests(tables.weekly_bars(spark, sf_dir))


def request_violations(spark, sf_dir):
    """One ticker's requests with a fault planted for each rule, another in each month; all other requests are sound."""
    month, mine = F.month("origin"), F.col("ticker") == "Brand#11"
    history, past, ahead = F.col("history"), F.col("history_dates"), F.col("forecast_dates")
    again = lambda dates, k: F.transform(dates, lambda x, i: F.when(i == k, F.get(dates, F.lit(k - 1))).otherwise(x))
    last = lambda field, value: F.transform(history, lambda x, i: F.when(i == 89, x.withField(field, F.lit(value))).otherwise(x))
    first_at_origin = F.concat(F.array("origin"), F.slice(ahead, 2, 9))
    faults = {
        "ticker": {1: F.lit("  ")},
        "history": {2: F.slice(history, 2, 89), 6: F.transform(history, lambda x: x.withField("volume", -x["volume"])), 11: last("close", float("nan")), 12: last("open", 0.0)},
        "history_dates": {3: again(past, 1), 4: F.slice(past, 2, 89)},
        "forecast_dates": {5: F.slice(ahead, 1, 9), 8: again(ahead, 2), 10: first_at_origin},
        "origin": {9: F.col("origin") - F.expr("INTERVAL 1 DAY")},
    }
    rows = _requests(spark, sf_dir)
    planted = {c: reduce(lambda kept, x: F.when(mine & (month == x[0]), x[1]).otherwise(kept), of.items(), F.col(c)) for c, of in faults.items()}
    broken = rows.withColumns(planted)
    twice = rows.where((month == 7) & mine)
    found = forecast.request_violations(broken.unionByName(twice.select(*broken.columns)))
    return found.select("ticker", F.col("origin").cast("date").alias("origin"), "rule")


def prediction_long(spark, sf_dir):
    rows = forecast.drift_long(_requests(spark, sf_dir))
    return rows.select("ticker", F.col("origin").cast("date").alias("origin"), F.col("horizon").cast("bigint").alias("horizon"), F.col("forecast_date").cast("date").alias("forecast_date"), _r("predicted_close", 4), _r("score"))


def _predictions(spark, sf_dir):
    return forecast.as_predictions(forecast.drift_long(_requests(spark, sf_dir)), "validation", CONFIG, ["ticker"])


def prediction_violations(spark, sf_dir):
    """A fault planted in each of fifteen tickers' shards, one for every rule of saved predictions that rows can break."""
    rows, at = _predictions(spark, sf_dir), F.col("horizon")
    day = F.expr("INTERVAL 1 DAY")
    of = lambda k: F.col("ticker") == f"Brand#{k}"
    faults = {
        "predicted_close": [(of(11) & (at == 3), F.lit(-1.0)), (of(13) & (at == 2), F.lit(float("nan")))],
        "forecast_date": [(of(12) & (at == 1), F.col("origin")), (of(31) & (at == 5), F.date_sub(F.col("forecast_date").cast("date"), 7).cast("timestamp_ntz"))],
        "batch_elapsed_seconds": [(of(14), F.lit(-1.0)), (of(21), at.cast("double"))],
        "model": [(of(15), F.lit("another"))],
        "amount_source": [(of(22) & (at == 5), F.lit("guessed"))],
        "horizon": [(of(23) & (at == 10), F.lit(11))],
        "score": [(of(24) & (at == 4), F.col("score") + 1), (of(32), F.col("score") + 0.01)],
        "input_end": [(of(25), F.col("origin") - day)],
        "effective_seed": [(of(33), F.col("effective_seed") + 1)],
        "logical_shard_id": [(of(34), F.concat(F.lit("x"), F.substring("logical_shard_id", 2, 23)))],
    }
    broken = rows.withColumns({c: reduce(lambda kept, x: F.when(*x).otherwise(kept), cases, F.col(c)) for c, cases in faults.items()})
    found = predictions.violations(broken.unionByName(rows.where(of(35) & (at == 1))), CONFIG)
    return found.groupBy("rule").agg(F.count("*").alias("shards"), F.sum("n").alias("n"))


def prediction_violations_clean(spark, sf_dir):
    return predictions.violations(_predictions(spark, sf_dir), CONFIG).select("rule", "n")


def pending_origins(spark, sf_dir):
    done = _predictions(spark, sf_dir).where("origin < '1996-01-01'")
    left = shards.pending(_requests(spark, sf_dir), shards.completed(done, check=False), CONFIG.model, CONFIG.seed)
    return left.select("ticker", F.col("origin").cast("date").alias("origin"))


def runtime(spark, sf_dir):
    """Seconds by shard stand for measured ones: a quarter of the number in a ticker's name."""
    seconds = F.substring("ticker", 7, 2).cast("double") / 4
    return evaluate.runtime(_predictions(spark, sf_dir).withColumn("batch_elapsed_seconds", seconds)).withColumn("seed", F.col("seed").cast("bigint"))


def wall_clock(spark, sf_dir):
    """Event times with an offset told behind them: the wall time stays."""
    told = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 3 == 0, "Z").when(F.col("event_id") % 3 == 1, "-05:00").otherwise("+0930"))
    time = wall(told)
    return tables.read(spark, sf_dir, "events").select("event_id", F.to_date(time).alias("session"), F.hour(time).cast("bigint").alias("hour"), F.minute(time).cast("bigint").alias("minute"))


def predictions_pandas(spark, sf_dir):
    """The predictor behind Arrow, shard by shard."""
    rows = forecast.assign_shards(_requests(spark, sf_dir), "validation", CONFIG)
    out = forecast.predict(rows, forecast.DriftPredictor(), CONFIG)
    return out.select("ticker", F.col("origin").cast("date").alias("origin"), F.col("horizon").cast("bigint").alias("horizon"), F.col("forecast_date").cast("date").alias("forecast_date"), _r("predicted_close", 4), _r("score"))


def _ledger(spark, sf_dir, strategies=COSTS):
    bars = tables.weekly_bars(spark, sf_dir)
    return ledger.simulate(bars, panel.momentum_scores(bars), strategies, check=False)


def _account(account: DataFrame) -> DataFrame:
    """Money on a log scale and as shares of the account: synthetic prices make sums of any size."""
    part = lambda c: F.round(F.col(c) / F.col("account_value"), 6).alias(c)
    return account.select(
        "strategy_id", "session", F.round(F.ln("account_value"), 6).alias("ln_account_value"), part("cash"), part("market_value"), part("fees"), part("traded_value"),
        F.col("positions").cast("bigint").alias("positions"), F.col("carried_valuations").cast("bigint").alias("carried_valuations"),
    )


def ledger_account(spark, sf_dir):
    return _account(_ledger(spark, sf_dir, COSTS[1:2]).account)


def cost_sensitivity(spark, sf_dir):
    return _account(_ledger(spark, sf_dir).account)


def ledger_fills(spark, sf_dir):
    rows = _ledger(spark, sf_dir, COSTS[1:2]).fills
    ln = lambda c: F.round(F.ln(c), 6).alias(f"ln_{c}")
    return rows.select("strategy_id", "signal_date", "execution_date", "ticker", "side", ln("shares"), _r("price"), ln("gross_value"), ln("fee"), "reason")


def ledger_rejects(spark, sf_dir):
    return _ledger(spark, sf_dir, COSTS[1:2]).rejects


def ledger_positions(spark, sf_dir):
    return _ledger(spark, sf_dir, COSTS[1:2]).positions.select("strategy_id", "ticker", F.round(F.ln("shares"), 6).alias("ln_shares"))


def net_return(spark, sf_dir):
    return _ledger(spark, sf_dir, COSTS[1:2]).account.select("strategy_id", "session", _r("net_return"))


def drawdown(spark, sf_dir):
    rows = ledger.drawdowns(_ledger(spark, sf_dir, COSTS[1:2]).account)
    return rows.select("strategy_id", "session", F.round(F.ln("peak"), 6).alias("ln_peak"), _r("drawdown"))


def portfolio_metrics(spark, sf_dir):
    rows = ledger.metrics(_ledger(spark, sf_dir).account)
    ln = lambda c, name: F.round(F.ln(c), 6).alias(name)
    return rows.select(
        "strategy_id", ln(F.col("net_cumulative_return") + 1, "ln_growth"), _r("net_sharpe_zero_cash"), _r("max_drawdown"), ln("turnover_dollars", "ln_turnover"),
        ln(F.col("transaction_costs_dollars") + 1, "ln_costs"), ln("ending_value", "ln_ending_value"),
    )


SEEDS = (42, 43, 44)


def seed_sensitivity(spark, sf_dir):
    """Seeds by costs: each seed adds its own noise to the scores, as sampling would; the end of each portfolio, and the mean RankIC."""
    bars = tables.weekly_bars(spark, sf_dir)
    labels = panel.forward_label(bars).select(F.col("session").alias("origin"), "ticker", "label")
    found = []
    for seed in SEEDS:
        noise = (evaluate.draw(seed, F.col("origin"), F.col("ticker")) / F.lit(2.0**32) - 0.5) / 10
        scores = panel.momentum_scores(bars).withColumn("score", F.col("score") + noise)
        ic = evaluate.rank_ic_mean(evaluate.rank_ic_daily(scores.join(labels, ["origin", "ticker"])))
        ends = ledger.metrics(ledger.simulate(bars, scores, COSTS, check=False).account)
        found.append(ends.crossJoin(F.broadcast(ic)).select(F.lit(seed).cast("bigint").alias("seed"), "strategy_id", F.round(F.ln("ending_value"), 6).alias("ln_ending_value"), _r("mean_rank_ic")))  # one row
    return reduce(DataFrame.unionByName, found)


def reconcile_violations(spark, sf_dir):
    """Books that don't balance: in March the account is a dollar off, in June the cash is negative, in September a hundredth too high."""
    run = _ledger(spark, sf_dir)
    month, value = F.month("session"), F.col("account_value")
    cash = F.when(month == 6, -value).when(month == 9, F.col("cash") + value / 100).otherwise(F.col("cash"))
    held = F.when(month == 6, value * 2).otherwise(F.col("market_value"))
    account = run.account.withColumns({"account_value": F.when(month == 3, value * 1.001 + 1).otherwise(cash + held), "cash": cash, "market_value": held})
    return ledger.unbalanced(account, run.fills, run.folded.select("strategy_id", "initial_cash"), 1e-6)


def reconcile_clean(spark, sf_dir):
    """Every session of sound books passes every rule, the identity too."""
    run = _ledger(spark, sf_dir)
    bad = ledger.reconcile(run, 1e-6).groupBy("strategy_id", "session").agg(F.count("*").alias("rules"))
    return run.account.join(bad, ["strategy_id", "session"], "left").groupBy("strategy_id").agg(F.count("*").alias("sessions"), F.count("rules").alias("broken"))


def buy_hold(spark, sf_dir):
    return ledger.buy_and_hold(tables.weekly_bars(spark, sf_dir)).select("session", F.round(F.ln("account_value"), 6).alias("ln_account_value"))


def refit_rows(spark, sf_dir):
    """What the last fit of the ranker sees, by split: origins between the splits are among it."""
    from ..operators import ranker

    rows = ranker.refit_rows(ranker.frame(tables.weekly_bars(spark, sf_dir), *SPLITS), *SPLITS)
    return rows.groupBy(F.coalesce("split", F.lit("between")).alias("split")).agg(F.count("*").alias("n"), F.min("origin").alias("origin"), F.max("label_end").alias("label_end"))


def ranker_candidates(spark, sf_dir):
    """The pooled-trees substitute's candidates with their validation RankIC, the best first."""
    from ..operators.ranker import search

    return search(tables.weekly_bars(spark, sf_dir), *SPLITS)


ALL: list[Query] = [
    bars_weekly, bars_events_hourly, forward_label, forward_label_strict, label_end_split, context_complete_90, turnover_proxy, causal_features, rank_average_ties, rank_ic_daily, rank_ic_mean,
    rank_ic_paired, mae_daily, mae_mean, coverage_daily, bootstrap_ci, bootstrap_paired, runtime, wall_clock, seed_sensitivity, topk_by_origin, signal_next_session, duplicate_keys, shard_identity, effective_seed, request_violations, prediction_long,
    prediction_violations, prediction_violations_clean, pending_origins, predictions_pandas, ledger_account, cost_sensitivity, ledger_fills, ledger_rejects, ledger_positions, net_return, drawdown,
    portfolio_metrics, reconcile_violations, reconcile_clean, buy_hold, refit_rows, ranker_candidates,
]


def _plain(query: Query) -> Query:
    """Dates and times as ISO text, which reads alike in every engine."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = query(spark, sf_dir)
        return out.withColumns({c: F.col(c).cast("string") for c, kind in out.dtypes if kind in ("date", "timestamp", "timestamp_ntz")})

    return run


def queries() -> dict[str, Query]:
    return {f.__name__: _plain(f) for f in ALL}
