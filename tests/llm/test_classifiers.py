import random
import zlib

import numpy as np
import pytest
from conftest_llm import ODD

from panelworks.llm import quality, toxicity

RNG = random.Random(4)
WORDS = ["".join(RNG.choices("abcdefgh", k=6)) for _ in range(300)]


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.fixture(scope="module")
def labelled(spark, docs):
    """Every fourth text is toxic and in capitals; half name a group, evenly over both labels."""
    rng = random.Random(6)
    pairs, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        text = rng.choices(WORDS, k=30) + ["women"] * (k % 8 < 4) + ([rng.choice(["vilest", "vilely", "horrid"])] if bad else [])
        rng.shuffle(text)
        pairs.append((k, " ".join(text).upper() + "!!" if bad else " ".join(text) + "."))
        labels.append((k, int(not bad), int(bad)))
    return docs(*pairs, *((None if i is None else i + 1000, t) for i, t in ODD)), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("run, name", [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_held_out_texts_are_told_apart(labelled, run, name):
    df, labels = labelled
    rows = {r["doc_id"]: r for r in run(df, labels).collect()}
    truth = {r["doc_id"]: r[name] for r in labels.collect()}
    right = [rows[k]["predicted"] == y for k, y in truth.items() if held(k)]
    assert len(right) > 50 and np.mean(right) >= 0.9
    assert all(rows[k]["held_out"] == held(k) for k in truth) and all(0 <= r["score"] <= 1 for r in rows.values())
    assert run(df, labels).count() == 400 + len(ODD) and rows[None]["held_out"] is False
    assert rows[1001]["score"] == rows[1002]["score"] == rows[1003]["score"]


@pytest.mark.parametrize("run, name", [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_held_out_labels_are_never_read(labelled, run, name):
    df, labels = labelled
    from pyspark.sql import functions as F

    other = labels.withColumn(name, F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col(name)).otherwise(F.col(name)))
    a, b = ({r["doc_id"]: r["score"] for r in run(df, x).collect()} for x in (labels, other))
    assert a == pytest.approx(b, abs=1e-9)


@pytest.mark.parametrize("run", [toxicity.toxicity, quality.quality])
def test_no_labels_and_no_rows(labelled, run):
    df, labels = labelled
    assert len({r["score"] for r in run(df, labels.limit(0)).collect()}) == 1
    assert run(df.limit(0), labels).count() == 0


def test_a_group_name_weighs_less_with_the_penalty(monkeypatch):
    rng = random.Random(8)
    sets, y = [], []
    for k in range(300):
        bad = k % 3 == 0
        sets.append(set(rng.choices(WORDS, k=20)) | ({"horrid"} if bad and k % 2 else set()) | ({"women"} if bad and rng.random() < 0.8 or rng.random() < 0.1 else {"men"} if rng.random() < 0.1 else set()))
        y.append(float(bad))
    names = sorted({x for s in sets for x in s})
    place = {x: k for k, x in enumerate(names)}
    row = np.concatenate([[i] * len(s) for i, s in enumerate(sets)])
    column = np.array([place[x] for s in sets for x in sorted(s)])
    pairs = [p for s in sets for p in toxicity.swaps(s)]
    gain, loss = (np.array([place.get(p[k], -1) for p in pairs]) for k in (1, 0))

    def gap(weight):
        monkeypatch.setattr(toxicity, "COUNTERFACTUAL", weight)
        _, w = toxicity.solve(row, column, len(names), np.array(y), gain, loss)
        return abs(w[place["women"]] - w[place["men"]])

    assert gap(5.0) < 0.2 * gap(0.0)


def test_only_toxic_rows_go(labelled):
    df, labels = labelled
    kept = toxicity.clean(df, toxicity.train(df, labels))
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == df.columns and sum(k is not None and k < 400 and k % 4 == 0 for k in ids) <= 5 and sum(k is not None and k < 400 and k % 4 != 0 for k in ids) >= 295


def test_rules_are_columns(spark, labelled):
    df, labels = labelled
    model = quality.train(df, labels)
    assert model.rules and "Python" not in quality.with_statistics(df)._jdf.queryExecution().executedPlan().toString()
