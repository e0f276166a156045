import math
import random

import duckdb
import pytest

from panelworks.llm import bitslice
from panelworks.llm.queries import OP5

SCHEMA = "vec_id bigint, embedding array<double>, label int, score int, v string, row string, block int, grp string"
ASKED = "vec_id % 100 = 0"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0, "", "", 0, "") for i, v in rows], SCHEMA).repartition(3)


def plain(rows, k):
    exact = lambda x: math.floor(1024 * x) if abs(x) < 1e300 else int(x) * 1024
    ok = [(i, [exact(x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, w) in enumerate(ok):
        if q % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(w, v)), i) for b, (i, v) in enumerate(ok) if a != b and len(v) == len(w))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


ODD = [(2000, None), (2002, [None] * 12), (2003, [float("nan")] * 12), (2004, [float("inf")] * 12), (None, [0.0] * 12), (2100, [1.0, 2.0]), (2101, [0.5, -2.0])]


@pytest.mark.parametrize("scale, n", [(1.0, 700), (1e-3, 300), (300.0, 300), (7e4, 300), (1.0, 5)])
def test_by_brute_force(spark, monkeypatch, scale, n):
    rng = random.Random(n)
    rows = [(i, [rng.gauss(0, scale) for _ in range(12)]) for i in range(n)]
    # ties, rows that repeat whole or by id only, empty vectors and a row of zeros
    rows += [(1000 + i, rows[0][1]) for i in range(150)] + [rows[0], (0, rows[1][1]), (0, rows[1][1]), (300, [0.0] * 12), (400, []), (401, []), *ODD]
    monkeypatch.setattr(bitslice, "ROWS", 256)
    monkeypatch.setattr(bitslice, "QUERIES", 4)
    assert sorted(tuple(r) for r in bitslice.top_k(table(spark, rows), ASKED, 10).collect()) == plain(rows, 10)


def test_large_components_equal_the_sql(spark):
    rng = random.Random(1)
    rows = [(k, [rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e-3) * big]), rng.gauss(0, 1e-9) * big]) for k in range(400) for big in [rng.choice([1.0, 7e4, 1e6, 1e9])]]
    rows += [(1000, [1e12, -1.0]), (1001, [1e-3, 1e12]), (1100, [7e4, 1.0]), (1100, [7e4, 1.0]), (1, [7e4, -7e4])]
    found = bitslice.top_k(table(spark, [r for r in rows if r[0] != 1000]), ASKED)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [r for r in rows if r[0] != 1000])
    got = sorted(tuple(r) for r in found.collect())
    assert got == sorted(con.execute(OP5).fetchall()) == plain([r for r in rows if r[0] != 1000], 10)


def test_only_results_beyond_64_bits_raise(spark):
    rows = [(0, [1e150, 1.0])] + [(k, [0.0, float(k)]) for k in range(1, 15)] + [(50, [-1e200, 0.0]), (51, [-1e307, 0.0])]
    assert sorted(tuple(r) for r in bitslice.top_k(table(spark, rows), ASKED).collect()) == plain(rows, 10)
    for more in ([(60, [1e100, 0.0])], [(0, [1e150, 1.0]), (60, [-1e100, 0.0])]):
        with pytest.raises(Exception, match="64 bits"):
            bitslice.top_k(table(spark, [(0, [1e150, 1.0]), *more]), ASKED).collect()


def test_digits():
    for x in [*range(-70, 70), 12345678901234567890, -(1 << 61)]:
        assert sum((-1 if minus else 1) << at for at, minus in bitslice.digits(x)) == x


def test_empty(spark):
    assert bitslice.top_k(table(spark, []), ASKED).count() == 0
