"""A long-only top-k portfolio with limited replacement, as a fold inside Catalyst.

Each strategy's sessions become one ordered array; ``aggregate`` carries cash,
holdings and marks through it and logs what happened.  Strategies run side by
side; within one the sessions follow one another, as each needs the last.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, let, tradable

#: What an order that no price could fill is given as its reason, and those of fills: fixed values.
NO_OPEN, DROPPED, BOUGHT = "missing_or_invalid_open", "topk_dropout", "initial_or_replacement"

_FILL = "struct<i:int,signal_date:{d},execution_date:{d},ticker:string,side:string,shares:double,price:double,gross_value:double,fee:double,reason:string>"
_REJECT = "struct<i:int,signal_date:{d},execution_date:{d},ticker:string,side:string,reason:string>"
_ACCOUNT = "struct<i:int,session:{d},cash:double,market_value:double,account_value:double,fees:double,traded_value:double,positions:int,carried_valuations:int>"
_HELD = "struct<ticker:string,shares:double,since:int>"


@dataclass(frozen=True)
class Strategy:
    """The rules of one portfolio; invalid ones raise ValueError."""

    strategy_id: str = "base"
    topk: int = 5
    n_drop: int = 1
    hold_thresh: int = 5
    target_exposure: float = 0.95
    initial_cash: float = 1_000_000.0
    cost_bps_per_side: float = 5.0

    def __post_init__(self):
        if self.topk <= 0 or self.n_drop < 0 or self.hold_thresh < 0:
            raise ValueError("invalid strategy parameters")
        if not 0 <= self.target_exposure <= 1 or self.initial_cash <= 0 or self.cost_bps_per_side < 0:
            raise ValueError("invalid capital or cost parameters")


@dataclass(frozen=True)
class Ledger:
    """The results by strategy; ``folded`` holds them all, so persist it where several are read."""

    folded: DataFrame

    def _log(self, name: str) -> DataFrame:
        return self.folded.select("strategy_id", F.explode(f"state.{name}").alias("x")).select("strategy_id", "x.*")

    @property
    def account(self) -> DataFrame:
        """A row per session, with ``net_return``: against the session before, and the first against the initial cash."""
        w = Window.partitionBy("strategy_id").orderBy("session")
        value = F.col("account_value")
        rows = self.folded.select("strategy_id", "initial_cash", F.explode("state.account").alias("x")).select("strategy_id", "initial_cash", "x.*")
        change = F.coalesce(F.try_divide(value, F.lag(value).over(w)) - 1, value / F.col("initial_cash") - 1)
        return rows.withColumn("net_return", change).drop("i", "initial_cash")

    @property
    def fills(self) -> DataFrame:
        return self._log("fills").drop("i")

    @property
    def rejects(self) -> DataFrame:
        return self._log("rejects").drop("i")

    @property
    def positions(self) -> DataFrame:
        return self._log("held").select("strategy_id", "ticker", "shares")

    @property
    def errors(self) -> DataFrame:
        return self.folded.where("state.error IS NOT NULL").select("strategy_id", F.col("state.error").alias("error"))


def _sells(s: Column, e: Column, p: Mapping[str, Column]) -> Column:
    """Holdings outside the first topk and old enough, worst first."""
    top = F.slice(e["ranked"], 1, p["topk"])
    leaving = F.filter(s["held"], lambda h: ~F.array_contains(top, h["ticker"]) & (e["i"] - h["since"] >= p["hold_thresh"]))
    worst = F.transform(leaving, lambda h: F.struct(F.coalesce(F.try_element_at(e["score"], h["ticker"]), F.lit(float("-inf"))).alias("score"), h["ticker"].alias("ticker"), h["shares"].alias("shares")))
    return F.slice(F.array_sort(worst), 1, p["n_drop"])


def _fill(e: Column, ticker: Column, side: str, shares: Column, price: Column, gross: Column, fee: Column) -> Column:
    reason = DROPPED if side == "sell" else BOUGHT
    return F.struct(
        e["i"].alias("i"), e["signal_date"].alias("signal_date"), e["session"].alias("execution_date"), ticker.alias("ticker"), F.lit(side).alias("side"), shares.alias("shares"), price.alias("price"), gross.alias("gross_value"), fee.alias("fee"), F.lit(reason).alias("reason")
    )


def _rejected(e: Column, orders: Column, side: str) -> Column:
    return F.transform(
        orders, lambda t: F.struct(e["i"].alias("i"), e["signal_date"].alias("signal_date"), e["session"].alias("execution_date"), t.alias("ticker"), F.lit(side).alias("side"), F.lit(NO_OPEN).alias("reason"))
    )


def _trade(s: Column, e: Column, p: Mapping[str, Column], day: str) -> Column:
    """Cash, holdings, fills and rejects after a session's orders."""
    rate = p["cost_bps_per_side"] / 10_000.0
    no_fills, no_rejects = F.array().cast(f"array<{_FILL.format(d=day)}>"), F.array().cast(f"array<{_REJECT.format(d=day)}>")

    def after_sells(sells: Column) -> Column:
        done = F.filter(sells, lambda x: F.map_contains_key(e["open"], x["ticker"]))
        failed = F.transform(F.filter(sells, lambda x: ~F.map_contains_key(e["open"], x["ticker"])), lambda x: x["ticker"])

        def sell(x: Column) -> Column:
            price = F.element_at(e["open"], x["ticker"])
            return let(x["shares"] * price, lambda gross: _fill(e, x["ticker"], "sell", x["shares"], price, gross, gross * rate))

        def bind(sold: Column) -> Column:
            gone = F.transform(sold, lambda x: x["ticker"])
            return F.struct(
                F.aggregate(sold, s["cash"], lambda a, x: a + (x["gross_value"] - x["fee"])).alias("cash"),
                F.filter(s["held"], lambda h: ~F.array_contains(gone, h["ticker"])).alias("held"),
                sold.alias("fills"),
                _rejected(e, failed, "sell").alias("rejects"),
            )

        return let(F.transform(done, sell), bind)

    def after_buys(b: Column) -> Column:
        own = F.transform(b["held"], lambda h: h["ticker"])
        orders = F.slice(F.filter(e["ranked"], lambda t: ~F.array_contains(own, t)), 1, F.greatest(F.lit(0), p["topk"] - F.size(b["held"])))

        def bind(wanted: Column) -> Column:
            each = F.try_divide(b["cash"] * p["target_exposure"], F.size(wanted).cast("double"))
            done = F.filter(wanted, lambda t: F.map_contains_key(e["open"], t))
            failed = F.filter(wanted, lambda t: ~F.map_contains_key(e["open"], t))

            def buy(a: Column, t: Column) -> Column:
                price = F.element_at(e["open"], t)
                gross = F.least(a["each"] / (1.0 + rate), a["cash"] / (1.0 + rate))
                return let(
                    gross,
                    lambda g: F.struct((a["cash"] - (g + g * rate)).alias("cash"), a["each"].alias("each"), F.concat(a["fills"], F.array(_fill(e, t, "buy", g / price, price, g, g * rate).cast(_FILL.format(d=day)))).alias("fills")),
                )

            start = F.struct(b["cash"].alias("cash"), each.alias("each"), no_fills.alias("fills"))
            return let(
                F.aggregate(done, start, buy),
                lambda a: F.struct(
                    a["cash"].alias("cash"),
                    F.concat(b["held"], F.transform(a["fills"], lambda x: F.struct(x["ticker"].alias("ticker"), x["shares"].alias("shares"), e["i"].alias("since")))).alias("held"),
                    F.concat(b["fills"], a["fills"]).alias("fills"),
                    F.concat(b["rejects"], _rejected(e, failed, "buy")).alias("rejects"),
                ),
            )

        return let(orders, bind)

    idle = F.struct(s["cash"].alias("cash"), s["held"].alias("held"), no_fills.alias("fills"), no_rejects.alias("rejects"))
    return F.when(e["has_signal"], let(let(_sells(s, e, p), after_sells), after_buys)).otherwise(idle)


def _step(s: Column, e: Column, p: Mapping[str, Column], day: str) -> Column:
    """The state after a session: orders first, then holdings at the close or at their last mark."""

    def value(t: Column) -> Column:
        fresh = F.map_filter(e["close"], lambda k, _: F.exists(t["held"], lambda h: h["ticker"] == k))
        marks = F.map_concat(F.map_filter(s["marks"], lambda k, _: ~F.map_contains_key(fresh, k)), fresh)

        def log(m: Column) -> Column:
            worth = F.aggregate(t["held"], F.lit(0.0), lambda a, h: a + h["shares"] * F.coalesce(F.try_element_at(m, h["ticker"]), F.lit(0.0)))
            unknown = F.filter(t["held"], lambda h: ~F.map_contains_key(m, h["ticker"]))
            carried = F.size(F.filter(t["held"], lambda h: ~F.map_contains_key(e["close"], h["ticker"])))

            def row(w: Column) -> Column:
                return F.struct(
                    e["i"].alias("i"),
                    e["session"].alias("session"),
                    t["cash"].alias("cash"),
                    w.alias("market_value"),
                    (t["cash"] + w).alias("account_value"),
                    F.aggregate(t["fills"], F.lit(0.0), lambda a, x: a + x["fee"]).alias("fees"),
                    F.aggregate(t["fills"], F.lit(0.0), lambda a, x: a + x["gross_value"]).alias("traded_value"),
                    F.size(t["held"]).alias("positions"),
                    carried.alias("carried_valuations"),
                )

            trouble = F.when(F.size(unknown) > 0, F.concat(F.lit("no valid valuation for held "), unknown[0]["ticker"], F.lit(" on "), e["session"].cast("string")))
            return F.struct(
                t["cash"].alias("cash"),
                t["held"].alias("held"),
                m.alias("marks"),
                F.concat(s["account"], F.array(let(worth, row))).alias("account"),
                F.concat(s["fills"], t["fills"]).alias("fills"),
                F.concat(s["rejects"], t["rejects"]).alias("rejects"),
                F.coalesce(s["error"], trouble).alias("error"),
            )

        return let(marks, log)

    return let(_trade(s, e, p, day), value)


def _required(df: DataFrame, columns: Sequence[str], what: str) -> None:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {what}={missing}")


def sessions_of(bars: DataFrame, scores: DataFrame, most: int) -> DataFrame:
    """A row per session: its number, the one before, that one's ranking, and prices of tickers that could be held.

    Only the first ``most`` of a ranking can ever be bought, so only tickers that
    are once among them have prices and scores gathered.
    """
    days = bars.select("session").distinct()
    w = Window.orderBy("session")
    days = days.select("session", F.row_number().over(w).alias("i"), F.lag("session").over(w).alias("signal_date"))
    good = scores.where(finite(F.col("score")))
    place = F.row_number().over(Window.partitionBy("origin").orderBy(F.desc("score"), "ticker"))
    first = good.withColumn("place", place).where(F.col("place") <= most)
    could = first.select("ticker").distinct()
    ranked = first.groupBy("origin").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "ticker"))), lambda x: x["ticker"]).alias("ranked"))
    known = good.join(could, "ticker", "left_semi").groupBy("origin").agg(F.map_from_entries(F.collect_list(F.struct("ticker", "score"))).alias("score"))
    signals = scores.groupBy("origin").agg(F.count("*").alias("n")).where("origin IS NOT NULL").select("origin").join(ranked, "origin", "left").join(known, "origin", "left")
    entry = lambda c: F.map_from_entries(F.array_compact(F.collect_list(F.when(tradable(F.col(c)), F.struct("ticker", F.col(c))))))
    prices = bars.join(could, "ticker", "left_semi").groupBy("session").agg(entry("open").alias("open"), entry("close").alias("close"))
    out = days.join(signals, days["signal_date"] == signals["origin"], "left").join(prices, "session", "left")
    nothing = F.create_map().cast("map<string,double>")
    return out.select(
        "i",
        "session",
        "signal_date",
        F.col("origin").isNotNull().alias("has_signal"),
        F.coalesce("ranked", F.array().cast("array<string>")).alias("ranked"),
        F.coalesce("score", nothing).alias("score"),
        F.coalesce("open", nothing).alias("open"),
        F.coalesce("close", nothing).alias("close"),
    )


def simulate(bars: DataFrame, scores: DataFrame, strategies: Sequence[Strategy] = (Strategy(),), *, check: bool = True) -> Ledger:
    """Run strategies on saved scores: decided after a session, executed at the next one's open.

    Needs ``session, ticker, open, close`` and ``origin, ticker, score``, unique
    by their first two; other columns are ignored.  With ``check``, duplicate
    keys, fewer than two sessions and holdings without any valid price raise
    ValueError; without, the plan stays lazy and errors are in ``Ledger.errors``.
    """
    _required(bars, ("session", "ticker", "open", "close"), "bars")
    _required(scores, ("origin", "ticker", "score"), "scores")
    bars = bars.select("session", F.col("ticker").cast("string").alias("ticker"), F.col("open").cast("double").alias("open"), F.col("close").cast("double").alias("close"))
    scores = scores.select("origin", F.col("ticker").cast("string").alias("ticker"), F.col("score").cast("double").alias("score"))
    if check:
        for rows, key, what in ((bars, ["session", "ticker"], "bar"), (scores, ["origin", "ticker"], "score")):
            if not rows.groupBy(*key).count().where("count > 1").isEmpty():
                raise ValueError(f"duplicate {what} keys")
        if bars.select("session").distinct().limit(2).count() < 2:
            raise ValueError("at least two sessions are required")
    spark, day = bars.sparkSession, bars.schema["session"].dataType.simpleString()
    days = sessions_of(bars, scores, 2 * max(x.topk for x in strategies))
    # a run needs its sessions one after another, so each strategy, a row of parameters, gets them in one ordered array
    in_order = lambda a, b: a["i"] - b["i"]
    fields = list(Strategy.__dataclass_fields__)
    rules = spark.createDataFrame([tuple(getattr(x, f) for f in fields) for x in strategies], "strategy_id string, topk int, n_drop int, hold_thresh int, target_exposure double, initial_cash double, cost_bps_per_side double")
    runs = days.crossJoin(F.broadcast(rules)).groupBy(*fields).agg(F.array_sort(F.collect_list(F.struct(*days.columns)), in_order).alias("days"))  # as many rows as strategies were given
    p = {f: F.col(f) for f in fields}
    zero = F.struct(
        F.col("initial_cash").alias("cash"),
        F.array().cast(f"array<{_HELD}>").alias("held"),
        F.create_map().cast("map<string,double>").alias("marks"),
        F.array().cast(f"array<{_ACCOUNT.format(d=day)}>").alias("account"),
        F.array().cast(f"array<{_FILL.format(d=day)}>").alias("fills"),
        F.array().cast(f"array<{_REJECT.format(d=day)}>").alias("rejects"),
        F.lit(None).cast("string").alias("error"),
    )
    state = f"struct<cash:double,held:array<{_HELD}>,marks:map<string,double>,account:array<{_ACCOUNT}>,fills:array<{_FILL}>,rejects:array<{_REJECT}>,error:string>".replace("{d}", day)
    folded = runs.withColumn("state", F.aggregate("days", zero.cast(state), lambda s, e: _step(s, e, p, day).cast(state))).drop("days")
    ledger = Ledger(folded)
    if check and (found := ledger.errors.limit(1).collect()):
        raise ValueError(found[0]["error"])
    return ledger


def metrics(account: DataFrame, annualization: int = 252) -> DataFrame:
    """A row of portfolio measures per strategy; the Sharpe ratio is null unless returns vary."""
    _required(account, ("account_value", "net_return"), "account")
    w = Window.partitionBy("strategy_id").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    rows = account.withColumn("drawdown", F.col("account_value") / F.max("account_value").over(w) - 1)
    first, last = (f("account_value", "session") for f in (F.min_by, F.max_by))
    spread = F.stddev_samp("net_return")
    return rows.groupBy("strategy_id").agg(
        (last / (first / (1 + F.min_by("net_return", "session"))) - 1).alias("net_cumulative_return"),
        F.when(spread > 0, F.sqrt(F.lit(float(annualization))) * F.try_divide(F.avg("net_return"), F.when(spread > 0, spread))).alias("net_sharpe_zero_cash"),
        F.min("drawdown").alias("max_drawdown"),
        F.sum("traded_value").alias("turnover_dollars"),
        F.sum("fees").alias("transaction_costs_dollars"),
        last.alias("ending_value"),
    )


def drawdowns(account: DataFrame) -> DataFrame:
    """``strategy_id, session, peak, drawdown``."""
    w = Window.partitionBy("strategy_id").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    return account.select("strategy_id", "session", F.max("account_value").over(w).alias("peak"), (F.col("account_value") / F.max("account_value").over(w) - 1).alias("drawdown"))


def reconcile(ledger: Ledger, atol: float = 1e-8) -> DataFrame:
    return unbalanced(ledger.account, ledger.fills, ledger.folded.select("strategy_id", "initial_cash"), atol)


def unbalanced(account: DataFrame, fills: DataFrame, start: DataFrame, atol: float = 1e-8) -> DataFrame:
    """``strategy_id, session, rule``: sessions where the books don't balance.

    ``identity``: cash and holdings make the account; ``leverage``: negative
    cash; ``replay``: cash as fills alone give it (within atol of its size), from
    the initial cash of ``start``.
    """
    flow = F.when(F.col("side") == "sell", F.col("gross_value") - F.col("fee")).otherwise(-(F.col("gross_value") + F.col("fee")))
    flows = fills.groupBy("strategy_id", F.col("execution_date").alias("session")).agg(F.sum(flow).alias("flow"))
    w = Window.partitionBy("strategy_id").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    rows = account.join(flows, ["strategy_id", "session"], "left").join(start, "strategy_id")
    rows = rows.withColumn("replayed", F.col("initial_cash") + F.sum(F.coalesce("flow", F.lit(0.0))).over(w))
    rows = rows.withColumn("size", F.greatest(F.lit(1.0), F.max("account_value").over(w)))
    rules = F.array(
        F.when(F.abs(F.col("account_value") - (F.col("cash") + F.col("market_value"))) > atol, F.lit("identity")),
        F.when(F.col("cash") < -atol * F.col("size"), F.lit("leverage")),
        F.when(F.abs(F.col("replayed") - F.col("cash")) > atol * F.col("size"), F.lit("replay")),
    )
    return rows.select("strategy_id", "session", F.explode(F.array_compact(rules)).alias("rule"))


def assert_reconciles(ledger: Ledger, atol: float = 1e-8) -> None:
    if found := reconcile(ledger, atol).limit(1).collect():
        raise AssertionError(f"books don't balance: {found[0]}")


def buy_and_hold(bars: DataFrame, exposure: float = 0.95, cash: float = 1_000_000.0) -> DataFrame:
    """``session, account_value``: equal dollars in each ticker with a valid open at the first session, then held.

    A missing close is carried from the ticker's last one; a ticker that has had
    none yet counts at its purchase price.
    """
    first = bars.agg(F.min("session").alias("session"))
    opened = bars.where(tradable(F.col("open"))).join(F.broadcast(first), "session").select("ticker", F.col("open").alias("cost"))  # one row
    count = opened.agg(F.count("*").alias("n"))
    shares = opened.crossJoin(F.broadcast(count)).select("ticker", "cost", (F.lit(cash * exposure) / F.col("n") / F.col("cost")).alias("shares"))  # one row
    # what a session adds is the change of each ticker's mark, so that carried marks need no row
    w = Window.partitionBy("ticker").orderBy("session")
    valid = bars.where(tradable(F.col("close"))).select("session", "ticker", "close").join(shares, "ticker")
    moved = valid.select("session", (F.col("shares") * (F.col("close") - F.coalesce(F.lag("close").over(w), F.col("cost")))).alias("change"))
    days = bars.select("session").distinct().join(moved.groupBy("session").agg(F.sum("change").alias("change")), "session", "left")
    running = F.sum(F.coalesce("change", F.lit(0.0))).over(Window.orderBy("session").rowsBetween(Window.unboundedPreceding, 0))
    return days.select("session", (F.lit(cash) + running).alias("account_value"))
