import datetime
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelworks.operators import ledger as L

DAYS = [d.date() for d in pd.bdate_range("2025-01-02", periods=9)]
BARS = [(d, t, float(b + i), float(b + i + 1)) for i, d in enumerate(DAYS) for t, b in (("A", 100), ("B", 50))]
SCORES = [(d, t, s) for i, d in enumerate(DAYS[:8]) for t, s in (("A", 2.0 if i < 5 else 0.0), ("B", 1.0 if i < 5 else 3.0))]


def bars(spark, rows=BARS):
    return spark.createDataFrame(rows, "session date, ticker string, open double, close double")


def scores(spark, rows=SCORES):
    return spark.createDataFrame(rows, "origin date, ticker string, score double")


def simulate(spark, b=BARS, s=SCORES, **rules):
    return L.simulate(bars(spark, b), scores(spark, s), [L.Strategy(**({"topk": 1, "initial_cash": 1000.0} | rules))])


def fills(ledger):
    return [(r["execution_date"], r["ticker"], r["side"], r["price"]) for r in ledger.fills.orderBy("execution_date", F.desc("side")).collect()]


def test_golden_next_open_execution(spark):
    ledger = simulate(spark)
    assert fills(ledger) == [(DAYS[1], "A", "buy", 101.0), (DAYS[6], "A", "sell", 106.0), (DAYS[6], "B", "buy", 56.0)]
    value = [r["account_value"] for r in ledger.account.orderBy("session").collect()]
    assert value == pytest.approx([1000, 1008.92647735538, 1018.32771732945, 1027.7289573035264, 1037.1301972775989, 1046.5314372516712, 1063.272891505088, 1081.0092289248853, 1098.7455663446824])
    m = L.metrics(ledger.account).first()
    assert m["net_cumulative_return"] == pytest.approx(0.09874556634468) and m["net_sharpe_zero_cash"] == pytest.approx(31.66720732707558)
    assert m["max_drawdown"] == 0 and m["turnover_dollars"] == pytest.approx(2939.291570141619) and m["transaction_costs_dollars"] == pytest.approx(1.46964578507081)
    L.assert_reconciles(ledger)


def test_missing_open_is_rejected_and_delays(spark):
    ledger = simulate(spark, [b for b in BARS if b[:2] != (DAYS[1], "A")])
    assert [tuple(r)[1:] for r in ledger.rejects.collect()] == [(DAYS[0], DAYS[1], "A", "buy", L.NO_OPEN)]
    assert [x[0] for x in fills(ledger)] == [DAYS[2], DAYS[7], DAYS[7]]


@pytest.mark.parametrize("price", [float("nan"), float("inf"), 0.0, -1.0, None])
def test_invalid_open_is_rejected(spark, price):
    ledger = simulate(spark, [(d, t, price if (d, t) == (DAYS[6], "A") else o, c) for d, t, o, c in BARS])
    assert ("sell", L.NO_OPEN) in [(r["side"], r["reason"]) for r in ledger.rejects.collect()]


def test_ties_go_by_ticker_and_non_finite_scores_are_dropped(spark):
    tied = [(d, t, 1.0) for d in DAYS for t in "BA"]
    assert fills(simulate(spark, s=tied))[0][1] == "A"
    odd = [(d, "A", x) for d, x in zip(DAYS, [float("nan"), float("inf"), None, float("-inf")])] + [(d, "B", 0.0) for d in DAYS[:4]]
    assert {x[1] for x in fills(simulate(spark, s=odd))} == {"B"}


def test_no_scores_is_no_trading_but_bad_scores_sell(spark):
    first = [(DAYS[0], "A", 1.0)]
    assert len(fills(simulate(spark, s=first, hold_thresh=0))) == 1
    bad = first + [(DAYS[3], "A", float("nan"))]
    assert fills(simulate(spark, s=bad, hold_thresh=0))[1][:3] == (DAYS[4], "A", "sell")


def test_hold_threshold_boundary_and_n_drop(spark):
    turn = [(DAYS[0], "A", 2.0), (DAYS[0], "B", 1.0)] + [(d, t, s) for d in DAYS[1:] for t, s in (("A", 1.0), ("B", 2.0))]
    for hold, day in ((1, DAYS[2]), (3, DAYS[4])):
        assert fills(simulate(spark, s=turn, hold_thresh=hold))[1][:3] == (day, "A", "sell")
    assert len(fills(simulate(spark, s=turn, hold_thresh=0, n_drop=0))) == 1


def test_carried_close_and_unknown_value(spark):
    gone = [(d, t, o, None if (d, t) == (DAYS[3], "A") else c) for d, t, o, c in BARS]
    row = simulate(spark, gone).account.where(F.col("session") == DAYS[3]).first()
    assert row["carried_valuations"] == 1 and row["market_value"] == pytest.approx(9.40123997407237 * 103)
    never = [(d, t, o, None if t == "A" else c) for d, t, o, c in BARS]
    with pytest.raises(ValueError, match="no valid valuation"):
        simulate(spark, never)


@pytest.mark.parametrize("exposure", [0.0, 1.0])
def test_exposure_limits(spark, exposure):
    ledger = simulate(spark, target_exposure=exposure)
    assert len(fills(ledger)) == 3
    L.assert_reconciles(ledger)


@pytest.mark.parametrize("rules", [dict(topk=0), dict(n_drop=-1), dict(hold_thresh=-1), dict(target_exposure=1.1), dict(initial_cash=0.0), dict(cost_bps_per_side=-1.0)])
def test_bad_rules(rules):
    with pytest.raises(ValueError):
        L.Strategy(**rules)


def test_bad_inputs(spark):
    with pytest.raises(ValueError, match="duplicate bar"):
        simulate(spark, BARS + BARS[:1])
    with pytest.raises(ValueError, match="duplicate score"):
        simulate(spark, s=SCORES + SCORES[:1])
    with pytest.raises(ValueError, match="two sessions"):
        simulate(spark, BARS[:2])
    with pytest.raises(ValueError, match="missing columns"):
        L.simulate(bars(spark).drop("open"), scores(spark))


def test_no_fills_have_a_schema(spark):
    ledger = simulate(spark, s=[])
    assert ledger.fills.count() == 0 and "reason" in ledger.rejects.columns
    assert L.metrics(ledger.account).first()["net_sharpe_zero_cash"] is None


def test_against_plain_python(spark):
    """The fold against a loop over the same rules, on random prices with holes."""
    import random

    rng, names = random.Random(7), [f"T{k:02d}" for k in range(12)]
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(k) for k in range(60)]
    b = [(d, t, rng.choice([None, 0.0] + [rng.uniform(5, 50)] * 9), rng.uniform(5, 50)) for d in days for t in names if rng.random() > 0.05]
    s = [(d, t, rng.choice([float("nan")] + [round(rng.gauss(0, 1), 1)] * 9)) for d in days for t in names if rng.random() > 0.1]
    rules = L.Strategy(topk=3, n_drop=2, hold_thresh=2, initial_cash=1000.0)
    price = {(d, t): (o, c) for d, t, o, c in b}
    cash, held, marks, out = 1000.0, {}, {}, []
    rate = rules.cost_bps_per_side / 10000
    score = {d: {t: x for e, t, x in s if e == d} for d in days}
    for i, day in enumerate(days):
        if i and score[days[i - 1]]:
            good = {t: x for t, x in score[days[i - 1]].items() if math.isfinite(x)}
            ranked = sorted(good, key=lambda t: (-good[t], t))
            out_of = sorted((good.get(t, -math.inf), t) for t, (_, since) in held.items() if t not in ranked[:3] and i - since >= 2)[:2]
            for _, t in out_of:
                if (p := price.get((day, t), (None,))[0] or 0) > 0:
                    gross = held.pop(t)[0] * p
                    cash += gross - gross * rate
            orders = [t for t in ranked if t not in held][: max(0, 3 - len(held))]
            each = cash * 0.95 / len(orders) if orders else 0
            for t in orders:
                if (p := price.get((day, t), (None,))[0] or 0) > 0:
                    gross = min(each / (1 + rate), cash / (1 + rate))
                    cash -= gross + gross * rate
                    held[t] = (gross / p, i)
        marks |= {t: price[day, t][1] for t in held if (day, t) in price}
        out.append(cash + sum(n * marks[t] for t, (n, _) in held.items()))
    ledger = L.simulate(bars(spark, b), scores(spark, s), [rules])
    assert [r["account_value"] for r in ledger.account.orderBy("session").collect()] == pytest.approx(out)
    L.assert_reconciles(ledger)
