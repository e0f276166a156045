"""The same results as the registered queries, in SQL that another engine runs."""

from __future__ import annotations

from ..functions.identity import SEED_MODULUS, SEED_TAG, SHARD_TAG
from .queries import SEEDS, SPLITS

_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, px"

BARS = f"""
trades AS (
  SELECT CAST(l_shipdate AS DATE) - CAST(isodow(l_shipdate) - 1 AS INTEGER) AS session, p_brand AS ticker,
         l_extendedprice / l_quantity AS px, l_quantity, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0
), bars AS (
  SELECT session, ticker, first(px ORDER BY {_ORDER}) AS open, max(px) AS high, min(px) AS low,
         last(px ORDER BY {_ORDER}) AS close, sum(l_quantity) AS volume
  FROM trades GROUP BY session, ticker
)"""

LABELS = """
labels_ AS (
  SELECT session, ticker, close,
         CASE WHEN count(close) OVER ahead = 10 THEN lead(session, 10) OVER w END AS label_end,
         CASE WHEN count(close) OVER ahead = 10 THEN avg(close) OVER ahead / close - 1 END AS label
  FROM bars
  WINDOW w AS (PARTITION BY ticker ORDER BY session), ahead AS (PARTITION BY ticker ORDER BY session ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)
)"""


def _scores(name: str, back: int) -> str:
    return f"""
{name} AS (
  SELECT * FROM (SELECT session AS origin, ticker, close / lag(close, {back}) OVER (PARTITION BY ticker ORDER BY session) - 1 AS score FROM bars)
  WHERE score IS NOT NULL
)"""


SCORES = _scores("scores", 4)
PAIRS = f"{BARS}, {LABELS}, {SCORES}, pairs AS (SELECT origin, s.ticker, score, label FROM scores s JOIN labels_ l ON l.session = s.origin AND l.ticker = s.ticker)"


def _ic(pairs: str, out: str, score: str = "score") -> str:
    """Daily RankIC by sums of rank products, without any engine's corr."""
    return f"""
{out}_ranks AS (
  SELECT origin, rank() OVER (PARTITION BY origin ORDER BY {score}) + (count(*) OVER (PARTITION BY origin, {score}) - 1) / 2.0 AS a,
         rank() OVER (PARTITION BY origin ORDER BY label) + (count(*) OVER (PARTITION BY origin, label) - 1) / 2.0 AS b
  FROM {pairs} WHERE {score} IS NOT NULL AND label IS NOT NULL
), {out} AS (
  SELECT origin, count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(a) * stddev_pop(b) > 0
         THEN covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) END AS rank_ic
  FROM {out}_ranks GROUP BY origin
)"""


PAIRED = f"""{BARS}, {LABELS}, {SCORES}, {_scores('slow', 12)}, both_ AS (SELECT a.origin, a.ticker, a.score AS a_score, b.score AS b_score, label
FROM scores a JOIN slow b ON a.origin = b.origin AND a.ticker = b.ticker JOIN labels_ l ON l.session = a.origin AND l.ticker = a.ticker),
{_ic('both_', 'ica', 'a_score')}, {_ic('both_', 'icb', 'b_score')}"""


def _seeded(seed: int) -> str:
    """Scores with the noise of a seed."""
    noise = f"(('0x' || substr(md5(concat_ws(':', '{seed}', CAST(origin AS VARCHAR), ticker)), 1, 8))::BIGINT / 4294967296.0::DOUBLE - 0.5) / 10"
    return f"{_scores('momentum', 4)}, scores AS (SELECT origin, ticker, score + {noise} AS score FROM momentum)"


def _bootstrap(block: int) -> str:
    return f"""
SELECT {block} AS block, CAST(max(n) AS BIGINT) AS dates, round(max(total / n), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high
FROM (
  SELECT r, sum(s1.s - coalesce(s0.s, 0)) / max(n) AS m, max(n) AS n, max(total) AS total
  FROM (
    SELECT r, n, total, first, first + least(l, n - b * l) AS last
    FROM (
      SELECT r, b, n, l, total, ('0x' || substr(md5(concat_ws(':', '42', '{block}', CAST(r AS VARCHAR), CAST(b AS VARCHAR))), 1, 8))::BIGINT % (n - l + 1) AS first
      FROM (SELECT max(i) AS n, least(max(i), {block}) AS l, arg_max(s, i) AS total FROM prefix), range(2000) t(r), range(1000) u(b) WHERE b < ceil(n / l)
    )
  ) d LEFT JOIN prefix s0 ON s0.i = d.first JOIN prefix s1 ON s1.i = d.last
  GROUP BY r
)"""


CONTEXT = """
context_ AS (
  SELECT session, ticker, close, volume, CAST(count(close) OVER w90 AS BIGINT) AS context_rows
  FROM bars WINDOW w90 AS (PARTITION BY ticker ORDER BY session ROWS BETWEEN 89 PRECEDING AND CURRENT ROW)
), requests AS (SELECT session AS origin, * FROM context_ WHERE context_rows = 90)"""

DRIFT = """
steps AS (
  SELECT session, ticker, close, close / lag(close) OVER (PARTITION BY ticker ORDER BY session) - 1 AS step FROM bars
), drift AS (
  SELECT session AS origin, ticker, close, avg(step) OVER (PARTITION BY ticker ORDER BY session ROWS BETWEEN 88 PRECEDING AND CURRENT ROW) AS d,
         count(*) OVER (PARTITION BY ticker ORDER BY session) AS place
  FROM steps
), path AS (
  SELECT ticker, origin, h AS horizon, CAST(origin + CAST(7 * h AS INTEGER) AS DATE) AS forecast_date, close, close * greatest(1 + h * d, 1e-6) AS predicted_close
  FROM drift, range(1, 11) t(h) WHERE place >= 90
)"""

PREDICTION_LONG = f"""
WITH {BARS}, {DRIFT}
SELECT ticker, origin, CAST(horizon AS BIGINT) AS horizon, forecast_date, round(predicted_close, 4) AS predicted_close,
       round(avg(predicted_close) OVER (PARTITION BY ticker, origin) / close - 1, 6) AS score
FROM path"""

_KEYS = "string_agg('[\"' || strftime(session, '%Y-%m-%dT00:00:00') || '\",\"' || ticker || '\"]', ',' ORDER BY session)"
SHARDS = f"""
SELECT ticker, substr(sha256('{{"contract":"{SHARD_TAG}","keys":[' || {_KEYS} || '],"seed":42,"split":"validation"}}'), 1, 24) AS logical_shard_id
FROM bars GROUP BY ticker"""

def _ledger(scores: str) -> str:
    """The ledger as a recursion over sessions; each level of subqueries is one step of a session."""
    return f"""
WITH RECURSIVE {BARS}, {scores}, rules(strategy_id, rate) AS (VALUES ('cost_00', 0.0::DOUBLE), ('cost_05', 0.0005::DOUBLE), ('cost_15', 0.0015::DOUBLE)),
days AS (SELECT session, row_number() OVER (ORDER BY session) AS i, lag(session) OVER (ORDER BY session) AS signal_date FROM (SELECT DISTINCT session FROM bars)),
ranked_ AS (
  SELECT origin, list(ticker ORDER BY score DESC, ticker) AS ranked, map_from_entries(list({{'k': ticker, 'v': score}})) AS score
  FROM scores WHERE NOT isnan(score) AND NOT isinf(score) GROUP BY origin
),
prices AS (
  SELECT session, map_from_entries(list({{'k': ticker, 'v': open}}) FILTER (WHERE open > 0)) AS open, map_from_entries(list({{'k': ticker, 'v': close}}) FILTER (WHERE close > 0)) AS close
  FROM bars GROUP BY session
),
frames AS (
  SELECT d.*, r.origin IS NOT NULL AS has_signal, coalesce(ranked, CAST([] AS VARCHAR[])) AS ranked, score, open, close
  FROM days d LEFT JOIN ranked_ r ON r.origin = d.signal_date JOIN prices USING (session)
),
fold AS (
  SELECT strategy_id, rate, CAST(0 AS BIGINT) AS i, CAST(NULL AS DATE) AS session, CAST(NULL AS DATE) AS signal_date, 1000000.0::DOUBLE AS cash,
         CAST([] AS STRUCT(ticker VARCHAR, shares DOUBLE, since BIGINT)[]) AS held, CAST(MAP {{}} AS MAP(VARCHAR, DOUBLE)) AS marks, 0.0::DOUBLE AS market_value,
         CAST([] AS STRUCT(ticker VARCHAR, side VARCHAR, shares DOUBLE, price DOUBLE, gross_value DOUBLE)[]) AS fills,
         CAST([] AS STRUCT(ticker VARCHAR, side VARCHAR)[]) AS rejects, CAST(0 AS BIGINT) AS carried_valuations
  FROM rules
  UNION ALL
  SELECT strategy_id, rate, i, session, signal_date, cash3, held3, marks3, coalesce(list_sum([h.shares * marks3[h.ticker] FOR h IN held3]), 0.0), fills3, rejects3,
         len([h FOR h IN held3 IF close[h.ticker] IS NULL])
  FROM (
    SELECT *, held2 || [{{'ticker': t, 'shares': g / open[t], 'since': i}} FOR t IN bought] AS held3, cash2 - len(bought) * (g + g * rate) AS cash3,
           map_concat(marks, map_from_entries([{{'k': t, 'v': close[t]}} FOR t IN list_concat([h.ticker FOR h IN held2], bought) IF close[t] IS NOT NULL])) AS marks3,
           [{{'ticker': x.t, 'side': 'sell', 'shares': x.sh, 'price': open[x.t], 'gross_value': x.sh * open[x.t]}} FOR x IN sold]
             || [{{'ticker': t, 'side': 'buy', 'shares': g / open[t], 'price': open[t], 'gross_value': g}} FOR t IN bought] AS fills3,
           [{{'ticker': x.t, 'side': 'sell'}} FOR x IN sells IF open[x.t] IS NULL] || [{{'ticker': t, 'side': 'buy'}} FOR t IN buys IF open[t] IS NULL] AS rejects3
    FROM (
      SELECT *, [t FOR t IN buys IF open[t] IS NOT NULL] AS bought, cash2 * 0.95 / greatest(len(buys), 1) / (1 + rate) AS g
      FROM (
        SELECT *, CASE WHEN has_signal THEN [t FOR t IN ranked IF NOT list_contains([h.ticker FOR h IN held2], t)][1:greatest(5 - len(held2), 0)] ELSE CAST([] AS VARCHAR[]) END AS buys
        FROM (
          SELECT *, [h FOR h IN held IF NOT list_contains([x.t FOR x IN sold], h.ticker)] AS held2,
                 cash + coalesce(list_sum([x.sh * open[x.t] - x.sh * open[x.t] * rate FOR x IN sold]), 0.0) AS cash2
          FROM (
            SELECT *, [x FOR x IN sells IF open[x.t] IS NOT NULL] AS sold
            FROM (
              SELECT f.strategy_id, f.rate, f.cash, f.held, f.marks, s.i, s.session, s.signal_date, s.has_signal, s.ranked, s.open, s.close,
                     CASE WHEN s.has_signal THEN list_sort([{{'s': coalesce(s.score[h.ticker], '-infinity'::DOUBLE), 't': h.ticker, 'sh': h.shares}} FOR h IN f.held
                       IF NOT list_contains(s.ranked[1:5], h.ticker) AND s.i - h.since >= 5])[1:1] ELSE CAST([] AS STRUCT(s DOUBLE, t VARCHAR, sh DOUBLE)[]) END AS sells
              FROM fold f JOIN frames s ON s.i = f.i + 1
            )
          )
        )
      )
    )
  )
),
account AS (
  SELECT strategy_id, session, cash, market_value, cash + market_value AS account_value, coalesce(list_sum([x.gross_value * rate FOR x IN fills]), 0.0) AS fees,
         coalesce(list_sum([x.gross_value FOR x IN fills]), 0.0) AS traded_value, CAST(len(held) AS BIGINT) AS positions, carried_valuations
  FROM fold WHERE i > 0
),
returns AS (
  SELECT *, coalesce(account_value / lag(account_value) OVER w - 1, account_value / 1000000.0 - 1) AS net_return, max(account_value) OVER w AS peak
  FROM account WINDOW w AS (PARTITION BY strategy_id ORDER BY session)
)
"""


LEDGER = _ledger(SCORES)

_ACCOUNT = """SELECT strategy_id, session, round(ln(account_value), 6) AS ln_account_value, round(cash / account_value, 6) AS cash, round(market_value / account_value, 6) AS market_value,
round(fees / account_value, 6) AS fees, round(traded_value / account_value, 6) AS traded_value, positions, carried_valuations FROM account"""

_BARS_OUT = "session, ticker, open, high, low, close, volume"


#: Columns of dates and times, as text in the result.
_DATES = {
    "session": "bars_weekly bars_events_hourly forward_label forward_label_strict label_end_split context_complete_90 turnover_proxy causal_features rank_average_ties signal_next_session ledger_account cost_sensitivity net_return drawdown reconcile_violations buy_hold wall_clock",
    "label_end": "forward_label forward_label_strict label_end_split refit_rows",
    "origin": "rank_ic_daily rank_ic_paired mae_daily coverage_daily topk_by_origin request_violations prediction_long predictions_pandas pending_origins refit_rows",
    "forecast_date": "prediction_long predictions_pandas",
    "signal_date": "signal_next_session ledger_fills ledger_rejects",
    "execution_date": "ledger_fills ledger_rejects",
}


def oracle_sql() -> dict[str, str]:
    """Each query's SQL, with dates as ISO text."""
    out = {}
    for name, sql in _sql().items():
        if found := [c for c, names in _DATES.items() if name in names.split()]:
            sql = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in found)}) FROM ({sql}) AS q"
        out[name] = sql
    return out


def _sql() -> dict[str, str]:
    dev, v0, v1, test = SPLITS
    return {
        "bars_weekly": f"WITH {BARS} SELECT {_BARS_OUT} FROM bars",
        "bars_events_hourly": f"""WITH b AS (SELECT date_trunc('hour', ts) AS session, event_type AS ticker, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
            last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events WHERE value > 0 GROUP BY 1, 2) SELECT {_BARS_OUT} FROM b""",
        "forward_label": f"WITH {BARS}, {LABELS} SELECT session, ticker, label_end, round(label, 6) AS label FROM labels_",
        "forward_label_strict": f"""WITH {BARS}, {LABELS}, days AS (SELECT session, row_number() OVER (ORDER BY session) AS i FROM (SELECT DISTINCT session FROM bars))
            SELECT l.session, ticker, label_end, round(label, 6) AS label FROM labels_ l JOIN days a ON a.session = l.session JOIN days b ON b.session = l.label_end WHERE b.i = a.i + 10""",
        "label_end_split": f"""WITH {BARS}, {LABELS}, s AS (SELECT session, ticker, label_end, CASE WHEN label_end <= DATE '{dev}' THEN 'development'
            WHEN session >= DATE '{v0}' AND session <= DATE '{v1}' AND label_end <= DATE '{v1}' THEN 'validation' WHEN session >= DATE '{test}' AND label_end IS NOT NULL THEN 'test' END AS split FROM labels_)
            SELECT * FROM s WHERE split IS NOT NULL""",
        "context_complete_90": f"WITH {BARS}, {CONTEXT} SELECT session, ticker, context_rows, context_rows = 90 AS complete FROM context_",
        "turnover_proxy": f"WITH {BARS} SELECT session, ticker, volume * (open + high + low + close) / 4 AS amount FROM bars",
        "causal_features": f"""WITH {BARS}, s AS (SELECT *, ln(close) - ln(lag(close) OVER (PARTITION BY ticker ORDER BY session)) AS step FROM bars)
            SELECT session, ticker, round(step, 6) AS return_1, round(close / lag(close, 4) OVER w - 1, 6) AS return_4, round(close / avg(close) OVER w12 - 1, 6) AS to_mean_12,
            round(stddev_samp(step) OVER w20, 6) AS spread_20,
            round(CASE WHEN max(high) OVER w20 > min(low) OVER w20 THEN (close - min(low) OVER w20) / (max(high) OVER w20 - min(low) OVER w20) END, 6) AS place_20,
            round(volume / avg(volume) OVER w20, 6) AS volume_20, round(ln(high) - ln(low), 6) AS span
            FROM s WINDOW w AS (PARTITION BY ticker ORDER BY session), w12 AS (PARTITION BY ticker ORDER BY session ROWS BETWEEN 11 PRECEDING AND CURRENT ROW),
            w20 AS (PARTITION BY ticker ORDER BY session ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
        "rank_average_ties": f"""WITH {BARS}, v AS (SELECT session, ticker, floor(volume / 20) AS x FROM bars)
            SELECT session, ticker, CAST(rank() OVER (PARTITION BY session ORDER BY x) + (count(*) OVER (PARTITION BY session, x) - 1) / 2.0 AS DOUBLE) AS rank FROM v""",
        "rank_ic_daily": f"WITH {PAIRS}, {_ic('pairs', 'ic')} SELECT origin, n, round(rank_ic, 6) AS rank_ic FROM ic",
        "rank_ic_mean": f"WITH {PAIRS}, {_ic('pairs', 'ic')} SELECT count(rank_ic) AS dates, round(avg(rank_ic), 6) AS mean_rank_ic FROM ic",
        "rank_ic_paired": f"""WITH {PAIRED} SELECT ica.origin, ica.n, round(ica.rank_ic - icb.rank_ic, 6) AS difference FROM ica JOIN icb ON ica.origin = icb.origin""",
        "mae_mean": f"""WITH {PAIRS}, d AS (SELECT origin, avg(abs(score - label)) AS mae, avg(abs(label)) AS zero_mae FROM pairs WHERE score IS NOT NULL AND label IS NOT NULL GROUP BY origin)
            SELECT count(mae) AS dates, round(avg(mae), 6) AS mean_mae, round(avg(mae * 10000), 3) AS mean_mae_bps, round(avg(zero_mae), 6) AS mean_zero_mae FROM d""",
        "mae_daily": f"""WITH {PAIRS} SELECT origin, round(avg(abs(score - label)), 6) AS mae, round(avg(abs(score - label)) * 10000, 3) AS mae_bps, round(avg(abs(label)), 6) AS zero_mae
            FROM pairs WHERE score IS NOT NULL AND label IS NOT NULL GROUP BY origin""",
        "coverage_daily": f"""WITH {BARS}, {SCORES} SELECT b.session AS origin, count(*) AS expected, count(s.score) AS scored, round(count(s.score) / count(*), 6) AS coverage, count(s.score) >= 3 AS enough
            FROM bars b LEFT JOIN scores s ON s.origin = b.session AND s.ticker = b.ticker GROUP BY b.session""",
        "bootstrap_paired": f"""WITH {PAIRED}, diff AS (SELECT ica.origin, ica.rank_ic - icb.rank_ic AS x FROM ica JOIN icb ON ica.origin = icb.origin),
            prefix AS (SELECT CAST(row_number() OVER (ORDER BY origin) AS BIGINT) AS i, sum(x) OVER (ORDER BY origin) AS s FROM diff WHERE x IS NOT NULL)
            {' UNION ALL '.join(_bootstrap(b) for b in (10, 20, 40))}""",
        "runtime": f"""WITH {BARS}, {CONTEXT} SELECT 'surrogate-drift' AS model, 42 AS seed, count(DISTINCT ticker) AS shards, count(*) AS forecasts,
            (SELECT sum(CAST(substr(ticker, 7, 2) AS DOUBLE) / 4) FROM (SELECT DISTINCT ticker FROM requests)) AS seconds FROM requests HAVING count(*) > 0""",
        "wall_clock": "SELECT event_id, CAST(ts AS DATE) AS session, hour(ts) AS hour, minute(ts) AS minute FROM events",
        "seed_sensitivity": " UNION ALL ".join(f"""SELECT * FROM ({_ledger(_seeded(seed))}, {LABELS}, pairs AS (SELECT origin, s.ticker, score, label FROM scores s JOIN labels_ l ON l.session = s.origin AND l.ticker = s.ticker),
            {_ic('pairs', 'ic')} SELECT {seed} AS seed, strategy_id, round(ln(arg_max(account_value, session)), 6) AS ln_ending_value, (SELECT round(avg(rank_ic), 6) FROM ic) AS mean_rank_ic FROM account GROUP BY strategy_id)""" for seed in SEEDS),
        "bootstrap_ci": f"""WITH {PAIRS}, {_ic('pairs', 'ic')}, prefix AS (SELECT CAST(row_number() OVER (ORDER BY origin) AS BIGINT) AS i, sum(rank_ic) OVER (ORDER BY origin) AS s FROM ic WHERE rank_ic IS NOT NULL)
            {' UNION ALL '.join(_bootstrap(b) for b in (10, 20, 40))}""",
        "topk_by_origin": f"""WITH {BARS}, {SCORES} SELECT origin, ticker, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY score DESC, ticker) AS rank FROM scores) WHERE rank <= 5""",
        "signal_next_session": f"WITH {BARS} SELECT session, lag(session) OVER (ORDER BY session) AS signal_date FROM (SELECT DISTINCT session FROM bars)",
        "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
        "shard_identity": f"WITH {BARS} {SHARDS}",
        "effective_seed": f"""WITH {BARS}, s AS ({SHARDS}) SELECT *, CAST(('0x' || substr(sha256('{SEED_TAG}' || chr(0) || '42' || chr(0) || logical_shard_id), 1, 16))::UBIGINT % {SEED_MODULUS} AS BIGINT) AS effective_seed FROM s""",
        "request_violations": f"""WITH {BARS}, {CONTEXT} SELECT CASE month(origin) WHEN 1 THEN '  ' ELSE ticker END AS ticker, CASE month(origin) WHEN 9 THEN origin - 1 ELSE origin END AS origin,
            ['ticker', 'history_size', 'history_order', 'history_dates_size', 'forecast_size', 'non_negative_volume', 'duplicate', 'forecast_order', 'origin', 'forecast_after_origin', 'finite', 'positive_prices'][month(origin)] AS rule
            FROM requests WHERE ticker = 'Brand#11'""",
        "prediction_long": PREDICTION_LONG,
        "predictions_pandas": PREDICTION_LONG,
        "prediction_violations": f"""WITH {BARS}, {CONTEXT}, m AS (SELECT ticker, count(*) AS m FROM requests GROUP BY ticker),
            planted(brand, rule, of_origins, once) AS (VALUES (11, 'positive_prices', 1, 0), (11, 'score_recomputed', 1, 0), (12, 'date_after_origin', 1, 0), (13, 'finite', 1, 0), (13, 'score_recomputed', 1, 0),
              (14, 'elapsed', 10, 0), (15, 'metadata', 10, 0), (21, 'constant', 0, 1), (22, 'amount_source', 1, 0), (23, 'horizons', 1, 0), (24, 'origin_constant', 1, 0), (25, 'input_end', 10, 0),
              (31, 'date_order', 1, 0), (32, 'score_recomputed', 1, 0), (33, 'effective_seed', 10, 0), (34, 'shard_id', 0, 1), (34, 'effective_seed', 10, 0),
              (35, 'unique_key', 1, 0), (35, 'horizons', 1, 0), (35, 'date_order', 1, 0), (35, 'score_recomputed', 1, 0))
            SELECT rule, count(*) AS shards, CAST(sum(of_origins * m + once) AS BIGINT) AS n FROM planted JOIN m ON m.ticker = 'Brand#' || brand GROUP BY rule""",
        "prediction_violations_clean": "SELECT CAST(NULL AS VARCHAR) AS rule, CAST(NULL AS BIGINT) AS n WHERE false",
        "pending_origins": f"WITH {BARS}, {CONTEXT} SELECT ticker, origin FROM requests WHERE origin >= DATE '1996-01-01'",
        "ledger_account": f"{LEDGER} {_ACCOUNT} WHERE strategy_id = 'cost_05'",
        "cost_sensitivity": f"{LEDGER} {_ACCOUNT}",
        "ledger_fills": f"""{LEDGER}, e AS (SELECT strategy_id, rate, signal_date, session, unnest(fills) AS x FROM fold WHERE strategy_id = 'cost_05')
            SELECT strategy_id, signal_date, session AS execution_date, x.ticker AS ticker, x.side AS side, round(ln(x.shares), 6) AS ln_shares, round(x.price, 6) AS price,
            round(ln(x.gross_value), 6) AS ln_gross_value, round(ln(x.gross_value * rate), 6) AS ln_fee, CASE x.side WHEN 'sell' THEN 'topk_dropout' ELSE 'initial_or_replacement' END AS reason FROM e""",
        "ledger_rejects": f"""{LEDGER}, e AS (SELECT strategy_id, signal_date, session, unnest(rejects) AS x FROM fold WHERE strategy_id = 'cost_05')
            SELECT strategy_id, signal_date, session AS execution_date, x.ticker AS ticker, x.side AS side, 'missing_or_invalid_open' AS reason FROM e""",
        "ledger_positions": f"""{LEDGER}, e AS (SELECT strategy_id, unnest(held) AS x FROM fold WHERE strategy_id = 'cost_05' AND i = (SELECT max(i) FROM days))
            SELECT strategy_id, x.ticker AS ticker, round(ln(x.shares), 6) AS ln_shares FROM e""",
        "net_return": f"{LEDGER} SELECT strategy_id, session, round(net_return, 6) AS net_return FROM returns WHERE strategy_id = 'cost_05'",
        "drawdown": f"{LEDGER} SELECT strategy_id, session, round(ln(peak), 6) AS ln_peak, round(account_value / peak - 1, 6) AS drawdown FROM returns WHERE strategy_id = 'cost_05'",
        "portfolio_metrics": f"""{LEDGER} SELECT strategy_id, round(ln(arg_max(account_value, session) / (arg_min(account_value, session) / (1 + arg_min(net_return, session)))), 6) AS ln_growth,
            round(CASE WHEN stddev_samp(net_return) > 0 THEN sqrt(252) * avg(net_return) / stddev_samp(net_return) END, 6) AS net_sharpe_zero_cash, round(min(account_value / peak - 1), 6) AS max_drawdown,
            round(ln(sum(traded_value)), 6) AS ln_turnover, round(ln(sum(fees) + 1), 6) AS ln_costs, round(ln(arg_max(account_value, session)), 6) AS ln_ending_value FROM returns GROUP BY strategy_id""",
        "reconcile_violations": f"""{LEDGER} SELECT strategy_id, session, rule FROM account JOIN (VALUES (3, 'identity'), (6, 'leverage'), (6, 'replay'), (9, 'replay')) p(m, rule) ON m = month(session)""",
        "reconcile_clean": f"{LEDGER} SELECT strategy_id, count(*) AS sessions, 0 AS broken FROM account GROUP BY strategy_id",
        "refit_rows": f"""WITH {BARS}, {LABELS}, s AS (SELECT *, ln(close) - ln(lag(close) OVER (PARTITION BY ticker ORDER BY session)) AS step FROM bars),
            f AS (SELECT session, ticker FROM (SELECT session, ticker, step, lag(close, 4) OVER w AS back, stddev_samp(step) OVER w20 AS spread, max(high) OVER w20 > min(low) OVER w20 AS moved FROM s
              WINDOW w AS (PARTITION BY ticker ORDER BY session), w20 AS (PARTITION BY ticker ORDER BY session ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
              WHERE step IS NOT NULL AND back IS NOT NULL AND spread IS NOT NULL AND moved),
            l AS (SELECT f.session, label_end, CASE WHEN label_end <= DATE '{dev}' THEN 'development' WHEN f.session >= DATE '{v0}' AND f.session <= DATE '{v1}' THEN 'validation' ELSE 'between' END AS split
              FROM f JOIN labels_ USING (session, ticker) WHERE label_end <= DATE '{v1}')
            SELECT split, count(*) AS n, min(session) AS origin, max(label_end) AS label_end FROM l GROUP BY split""",
        "buy_hold": f"""WITH {BARS}, f AS (SELECT ticker, open AS cost FROM bars WHERE session = (SELECT min(session) FROM bars) AND open > 0), h AS (SELECT ticker, cost, 950000.0 / (SELECT count(*) FROM f) / cost AS shares FROM f),
            grid AS (SELECT d.session, h.ticker, cost, shares, b.close FROM (SELECT DISTINCT session FROM bars) d CROSS JOIN h LEFT JOIN bars b ON b.session = d.session AND b.ticker = h.ticker),
            marked AS (SELECT session, shares, coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY session), cost) AS mark FROM grid)
            SELECT session, round(ln(50000.0 + sum(shares * mark)), 6) AS ln_account_value FROM marked GROUP BY session""",
    }
