import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelworks.functions import identity
from panelworks.operators import forecast as R
from panelworks.operators import predictions as V
from panelworks.sources import shards

CONFIG = R.ForecastConfig()
PAST = pd.bdate_range("2024-01-02", periods=100)
SCHEMA = "ticker string, origin timestamp_ntz, history array<struct<open:double,high:double,low:double,close:double,volume:double>>, history_dates array<timestamp_ntz>, forecast_dates array<timestamp_ntz>"


def request(ticker="AAPL", shift=0, **change):
    dates = [d.to_pydatetime() for d in PAST[shift : shift + 100]] if shift == 0 else [d.to_pydatetime() for d in pd.bdate_range(PAST[shift], periods=100)]
    history = [(100.0 + shift + i, 102.0 + shift + i, 98.0 + shift + i, 101.0 + shift + i, 1000.0 + i) for i in range(90)]
    row = dict(ticker=ticker, origin=dates[89], history=history, history_dates=dates[:90], forecast_dates=dates[90:]) | change
    return tuple(row[k] for k in ("ticker", "origin", "history", "history_dates", "forecast_dates"))


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


class Fixed:
    """Closes from 1.01 to 1.10 times the last one."""

    def predict_batch(self, frames, dates, future, config):
        for f in frames:
            assert list(f.columns) == ["open", "high", "low", "close", "volume"] and len(f) == 90
        return [pd.DataFrame({"close": f["close"].iloc[-1] * np.linspace(1.01, 1.10, 10)}, index=a) for f, a in zip(frames, future)]


def made(spark, *rows, predictor=None):
    rows = R.assign_shards(frame(spark, *rows), "validation", CONFIG)
    return R.predict(rows, predictor or Fixed(), CONFIG, clock=lambda: 0.0)


@pytest.fixture(scope="module")
def good(spark):
    rows = made(spark, request(), request("MSFT", 1)).toPandas()
    return spark.createDataFrame(rows, R.PREDICTION_SCHEMA)


def test_predictions_have_the_contract(spark, good):
    assert good.columns == R.PREDICTION_COLUMNS and good.count() == 20
    assert {round(r["score"], 9) for r in good.select("score").collect()} == {0.055}
    V.check(good, CONFIG)


@pytest.mark.parametrize("change", [dict(temperature=1.0), dict(top_p=0.8), dict(top_k=5), dict(sample_count=1), dict(context=89), dict(horizon=9), dict(seed=-1), dict(model_revision="ABC")])
def test_config_cannot_drift(change):
    with pytest.raises(R.ContractError):
        R.ForecastConfig(**change)


@pytest.mark.parametrize(
    "change, rule",
    [
        (dict(ticker=" "), "ticker"),
        (dict(history=request()[2][1:]), "history_size"),
        (dict(history_dates=request()[3][::-1], origin=request()[3][0]), "history_order"),
        (dict(history_dates=request()[3][1:]), "history_dates_size"),
        (dict(forecast_dates=request()[4][:9]), "forecast_size"),
        (dict(forecast_dates=request()[4][::-1]), "forecast_order"),
        (dict(origin=request()[3][88]), "origin"),
        (dict(forecast_dates=request()[3][-1:] + request()[4][:9]), "forecast_after_origin"),
        (dict(history=[(float("nan"), *request()[2][0][1:])] + request()[2][1:]), "finite"),
        (dict(history=[(0.0, *request()[2][0][1:])] + request()[2][1:]), "positive_prices"),
        (dict(history=[(*request()[2][0][:4], -1.0)] + request()[2][1:]), "non_negative_volume"),
    ],
)
def test_request_rules(spark, change, rule):
    assert rule in {r["rule"] for r in R.request_violations(frame(spark, request(**change))).collect()}


def test_clean_and_duplicate_requests(spark):
    assert R.request_violations(frame(spark, request(), request("MSFT"))).count() == 0
    with pytest.raises(R.ContractError, match="duplicate"):
        R.check_requests(frame(spark, request(), request()))


def test_future_and_order_change_nothing(spark, good):
    again = made(spark, request("MSFT", 1), request())
    assert again.exceptAll(good).count() == 0


@pytest.mark.parametrize("answer", [lambda f, a: f.iloc[:9], lambda f, a: f.set_index(f.index[::-1]), lambda f, a: f * float("nan"), lambda f, a: f * -1, lambda f, a: f.rename(columns={"close": "x"})])
def test_bad_predictors_fail(spark, answer):
    class Bad(Fixed):
        def predict_batch(self, *a):
            return [answer(f, None) for f in super().predict_batch(*a)]

    with pytest.raises(Exception, match="number of requests|no frame of|dates differ|finite and positive"):
        made(spark, request(), predictor=Bad()).collect()


def test_identity_is_canonical():
    keys = [("2024-05-06T00:00:00", "AAPL"), ("2024-05-07T00:00:00", "MSFT")]
    one = identity.shard_identity("validation", 42, keys)
    assert one == identity.shard_identity("validation", 42, keys[::-1]) and len(one) == 24
    assert len({one, identity.shard_identity("test", 42, keys), identity.shard_identity("validation", 43, keys)}) == 3
    assert one in identity.shard_path("d", "validation", 42, one)
    for bad in ([], keys[:1] * 2):
        with pytest.raises(ValueError):
            identity.shard_identity("validation", 42, bad)


def test_columns_equal_python(spark):
    rows = spark.createDataFrame([("A", datetime.datetime(2024, 1, 2)), ("B", datetime.datetime(2024, 1, 2, 0, 0, 0, 5))], "ticker string, origin timestamp_ntz")
    got = identity.shard_identities(rows.withColumn("g", F.lit(1)), ["g"], F.lit("s"), F.lit(7)).first()["logical_shard_id"]
    assert got == identity.shard_identity("s", 7, [("2024-01-02T00:00:00", "A"), ("2024-01-02T00:00:00.000005", "B")])
    seed = spark.range(1).select(identity.effective_seed_column(F.lit(7), F.lit(got))).first()[0]
    assert seed == identity.effective_seed(7, got)
    with pytest.raises(Exception, match="ASCII"):
        identity.shard_identities(rows.withColumn("ticker", F.lit("BÉ")), ["origin"], F.lit("s"), F.lit(7)).collect()


@pytest.mark.parametrize(
    "rule, column, value",
    [
        ("finite", "score", float("nan")), ("positive_prices", "predicted_close", 0.0), ("elapsed", "batch_elapsed_seconds", -1.0), ("constant", "batch_elapsed_seconds", 9.0),
        ("metadata", "temperature", 0.7), ("amount_source", "amount_source", "guess"), ("horizons", "horizon", 11), ("origin_constant", "score", 0.2), ("input_end", "input_end", datetime.datetime(2020, 1, 1)),
        ("date_order", "forecast_date", datetime.datetime(2030, 1, 1)), ("score_recomputed", "predicted_close", 900.0), ("shard_id", "ticker", "OTHER"), ("effective_seed", "effective_seed", 1),
    ],
)
def test_each_prediction_rule(spark, good, rule, column, value):
    bad = good.withColumn(column, F.when((F.col("ticker") == "AAPL") & (F.col("horizon") == 2), F.lit(value)).otherwise(F.col(column)).cast(good.schema[column].dataType))
    assert rule in {r["rule"] for r in V.violations(bad, CONFIG).collect()}


def test_other_prediction_rules(spark, good):
    rules = lambda df: {r["rule"] for r in V.violations(df, CONFIG).collect()}
    assert "unique_key" in rules(good.unionByName(good.limit(1)))
    early = good.withColumn("forecast_date", F.when(F.col("horizon") == 1, F.col("origin")).otherwise(F.col("forecast_date")))
    assert "date_after_origin" in rules(early)
    close = good.withColumn("score", F.col("score") * 1.000009)
    assert "score_recomputed" not in rules(close)
    for bad in (good.withColumn("Label", F.lit(1)), good.drop("score"), good.limit(0)):
        with pytest.raises(R.ShardError):
            V.check(bad, CONFIG)


def test_shards_write_resume_and_replace(spark, good, tmp_path):
    path = f"{tmp_path}/a.parquet"
    shards.write(good, path, CONFIG)
    assert sorted(x.name for x in tmp_path.iterdir()) == ["a.parquet"]
    done = shards.completed(shards.read(spark, [path]))
    assert done.count() == 2
    wanted = frame(spark, request(), request("MSFT", 1), request("NEW"))
    assert [r["ticker"] for r in shards.pending(wanted, done, CONFIG.model, 42).collect()] == ["NEW"]
    assert shards.pending(wanted, done, CONFIG.model, 43).count() == 3
    with pytest.raises(R.ShardError, match="duplicate"):
        shards.completed(shards.read(spark, [path, path]))
    with pytest.raises(R.ShardError):
        shards.write(good.withColumn("label", F.lit(1)), path, CONFIG)
    with pytest.raises(Exception):
        shards.write(good.withColumn("score", F.raise_error(F.lit("stop")).cast("double")), path, validate=False)
    assert shards.read(spark, [path]).count() == 20 and sorted(x.name for x in tmp_path.iterdir()) == ["a.parquet"]
    shards.write(good, path, CONFIG)
    assert shards.read(spark, [path]).count() == 20
    before = (tmp_path / "a.parquet").read_bytes()
    with pytest.raises(R.ShardError):  # what is on disk is checked before it takes the place
        shards.write(good.withColumn("seed", F.lit(7)), path, CONFIG)
    assert (tmp_path / "a.parquet").read_bytes() == before and sorted(x.name for x in tmp_path.iterdir()) == ["a.parquet"]
    with pytest.raises(R.ShardError):
        shards.write(good, f"{tmp_path}/a.csv", CONFIG)
    (tmp_path / "b.parquet").mkdir()
    with pytest.raises(R.ShardError, match="no file"):
        shards.write(good, f"{tmp_path}/b.parquet", CONFIG)


def test_lazily_checked_shards_raise_where_they_are_used(spark, good):
    for bad, said in ((good.unionByName(good.limit(1)), "duplicate"), (good.withColumn("logical_shard_id", F.when(F.col("horizon") == 1, "x").otherwise(F.col("logical_shard_id"))), "two shards")):
        with pytest.raises(Exception, match=said):
            shards.pending(good.select("ticker", "origin").distinct(), shards.completed(bad, check=False), CONFIG.model, 42).collect()
        with pytest.raises(R.ShardError, match=said):
            shards.completed(bad)


def test_partitioned_writes_replace_their_own_shards(spark, good, tmp_path):
    for _ in range(2):
        shards.write_partitioned(good, f"{tmp_path}/all")
    assert spark.read.parquet(f"{tmp_path}/all").count() == 20
