import datetime
import hashlib
import io
import json
import subprocess
import zipfile

import pytest
from pyspark.sql import functions as F

from panelworks.functions.columns import wall_clock
from panelworks.operators import evaluate, panel
from panelworks.sources import manifest, package, tables
from panelworks.streaming.bars import run_available, stream_bars

DAY = datetime.date(2024, 1, 1)


def bars(spark, n=15, tickers="A", skip=()):
    rows = [(DAY + datetime.timedelta(i), t, 1.0, 2.0, 0.5, float(i + 1), 1.0) for i in range(n) for t in tickers if (i, t) not in skip]
    return spark.createDataFrame(rows, "session date, ticker string, open double, high double, low double, close double, volume double")


def test_label_needs_a_whole_window(spark):
    rows = panel.forward_label(bars(spark)).where("label IS NOT NULL").orderBy("session").collect()
    assert len(rows) == 5 and rows[0]["label"] == pytest.approx(6.5 - 1) and rows[0]["label_end"] == DAY + datetime.timedelta(10)


def test_strict_labels_need_the_very_next_sessions(spark):
    rows = bars(spark, 15, "AB", {(3, "B")})
    assert panel.forward_label(rows).where("ticker = 'B' AND label IS NOT NULL").count() == 4
    assert panel.forward_label(rows, strict=True).where("ticker = 'B' AND label IS NOT NULL").count() == 1


def test_the_future_changes_no_feature(spark):
    rows = bars(spark, 40)
    day = DAY + datetime.timedelta(30)
    later = rows.withColumn("close", F.when(F.col("session") > day, 999.0).otherwise(F.col("close")))
    past = lambda r: panel.causal_features(r).where(F.col("session") <= day)
    assert past(rows).exceptAll(past(later)).count() == 0


def test_ranks_share_ties_and_constant_scores_have_no_ic(spark):
    rows = spark.createDataFrame([("d", t, s, y) for t, s, y in (("a", 1.0, 1.0), ("b", 2.0, 2.0), ("c", 2.0, 3.0), ("d", 4.0, 4.0))], "origin string, ticker string, score double, label double")
    assert sorted(r[0] for r in rows.select(panel.average_rank(F.col("score"), "origin")).collect()) == [1, 2.5, 2.5, 4]
    assert evaluate.rank_ic_daily(rows).first()["rank_ic"] == pytest.approx(0.9486832980505138)
    assert evaluate.rank_ic_daily(rows.withColumn("score", F.lit(1.0))).first()["rank_ic"] is None
    assert evaluate.rank_ic_daily(rows.limit(2)).first()["rank_ic"] is None


def test_bootstrap_covers_the_mean_and_is_repeatable(spark):
    daily = spark.range(100).select(F.col("id").alias("origin"), ((F.col("id") * 37) % 11).cast("double").alias("x"))
    one = evaluate.block_bootstrap(daily, "x", (10,), 200).first()
    assert one == evaluate.block_bootstrap(daily, "x", (10,), 200).first() and one["low"] < one["mean"] < one["high"] and one["dates"] == 100
    assert evaluate.block_bootstrap(daily.limit(3), "x", (10,), 20).first()["low"] == pytest.approx(3.6667, abs=2)


def test_pinned_files_of_splits(spark, tmp_path):
    for k, name in enumerate(("train", "val", "test", "other")):
        spark.range(k, 3).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    files = {x: str(next((tmp_path / x).glob("*.parquet"))) for x in ("train", "val", "test")}
    pins = {x: hashlib.sha256(open(f, "rb").read()).hexdigest() for x, f in files.items()}
    got = {r["file_split"]: r["count"] for r in tables.split_scan(spark, files, pins).groupBy("file_split").count().collect()}
    assert got == {"train": 3, "val": 2, "test": 1}
    with pytest.raises(ValueError, match="val"):
        tables.split_scan(spark, files, pins | {"val": "0" * 64})


def test_wall_time_stays_whatever_the_zone(spark):
    told = ["2024-01-02T23:00:00-05:00", "2024-01-02 23:00:00Z", "2024-01-02T23:00:00+0930", "2024-01-02T23:00:00.5", "2024-01-02", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in told], "t string").select(wall_clock(F.col("t"))).collect()]
    late = datetime.datetime(2024, 1, 2, 23)
    assert got == [late, late, late, late.replace(microsecond=500_000), datetime.datetime(2024, 1, 2), None]


def test_splits(spark):
    rows = panel.assign_split(panel.forward_label(bars(spark, 40)), "2024-01-15", "2024-01-10", "2024-01-25", "2024-01-26")
    assert {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()} == {"development": 5, "validation": 6, "test": 5, None: 24}


def test_plans_push_down_and_prune(spark, sf):
    plan = tables.weekly_bars(spark, sf).select("session")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,0.0)" in plan and "l_tax" not in plan


def test_json_files_are_replaced_whole(spark, tmp_path):
    path = f"{tmp_path}/deep/er/run.json"
    for value in ({"z": [1, {"y": DAY}], "a": None}, {"only": "this"}):
        assert manifest.atomic_write_json(path, value, spark) == path
    assert (tmp_path / "deep" / "er" / "run.json").read_text() == '{\n  "only": "this"\n}\n'
    with pytest.raises(TypeError):
        manifest.atomic_write_json(path, {("no", "key"): 1}, spark)
    assert [x.name for x in (tmp_path / "deep" / "er").iterdir() if not x.name.endswith(".crc")] == ["run.json"]
    assert json.loads((tmp_path / "deep" / "er" / "run.json").read_text()) == {"only": "this"}


def test_hashes_and_provenance(spark, tmp_path):
    assert manifest.canonical_json({"z": 1, "a": [DAY, 2.5]}) == '{"a":["2024-01-01",2.5],"z":1}'
    assert manifest.stable_hash({"z": 1, "a": "\u00e9"}) == hashlib.sha256(b'{"a":"\\u00e9","z":1}').hexdigest()
    run = manifest.Provenance({"x": 1}, {"commit": None})
    assert run.identity == manifest.Provenance({"x": 1}, {"commit": None}, {}).identity != manifest.Provenance({"x": 2}, {"commit": None}).identity
    told = json.loads(open(run.save(f"{tmp_path}/p.json", spark)).read())
    assert told["identity"] == run.identity and {"captured_at", "hostname", "platform", "python", "pid"} <= set(told["machine"])
    assert manifest.runtime_environment(spark)["spark"] == spark.version


def test_configurations_are_mappings(tmp_path):
    (tmp_path / "ok.yaml").write_text('{"outer": {"inner": [1]}}')
    found = manifest.load_config(tmp_path / "ok.yaml")
    assert found["outer"] == {"inner": [1]} and found["_meta"] == {"path": str(tmp_path / "ok.yaml"), "sha256": hashlib.sha256(b'{"outer": {"inner": [1]}}').hexdigest()}
    (tmp_path / "list.yaml").write_text("[1]")
    with pytest.raises(ValueError):
        manifest.load_config(tmp_path / "list.yaml")


def test_git_state(tmp_path, monkeypatch):
    monkeypatch.setenv("GIT_CEILING_DIRECTORIES", str(tmp_path))
    monkeypatch.setenv("GIT_CONFIG_GLOBAL", "/dev/null")
    own = tmp_path / "own"
    own.mkdir()
    with pytest.raises(subprocess.CalledProcessError):
        manifest.git_state(own)
    git = lambda *a: subprocess.run(["git", "-C", str(own), "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True, text=True).stdout.strip()
    git("init", "-q")
    assert manifest.git_state(own) == {"commit": None, "dirty": False, "status": []}
    (own / "a b.txt").write_text("1")
    assert manifest.git_state(own) == {"commit": None, "dirty": True, "status": ["?? a b.txt"]}
    git("add", "."), git("commit", "-qm", "one")
    assert manifest.git_state(own) == {"commit": git("rev-parse", "HEAD"), "dirty": False, "status": []}
    (own / "a b.txt").write_text("2")
    assert manifest.git_state(own)["status"] == [" M a b.txt"]


def test_the_package_is_shipped_whole_and_once(spark):
    names = zipfile.ZipFile(io.BytesIO(package.archive())).namelist()
    assert "panelworks/operators/ledger.py" in names and package.archive() == package.archive()
    before = len(spark.sparkContext._python_includes)
    package.ship(spark), package.ship(spark)
    assert len(spark.sparkContext._python_includes) <= before + 1


def test_stream_equals_batch(spark, sf, tmp_path):
    events = tables.read(spark, sf, "events")
    events.write.parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    run_available(stream_bars(rows), f"{tmp_path}/out", f"{tmp_path}/check")
    got = spark.read.parquet(f"{tmp_path}/out")
    want = stream_bars(events)
    assert got.exceptAll(want).count() == 0 and got.count() > 0.9 * want.count()
