import random
import re

import xxhash
from conftest_llm import ODD

from pyspark.sql import functions as F

from panelworks.llm import simhash
from panelworks.llm.common import table


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(fps):
    """The least node reachable over links of at most two bits."""
    root = {x: x for x in fps}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in fps:
        for b in fps:
            if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {x: find(x) for x in fps}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_are_the_plain_ones():
    for text in (None, "", "  ", "a", "A b", "Éa b c", "x y z x y z q\x1fw", " ".join(str(i % 7) for i in range(1000))):
        assert simhash.fingerprint(text.encode() if text is not None else None) == plain(text)


def test_blocks_change_nothing(monkeypatch):
    text = " ".join(str(i * i % 97) for i in range(500)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text) == whole


def test_links_and_components_by_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    cloud = [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base[:8] for _ in range(25)]
    fps = sorted({signed(x) for x in base + cloud})
    want = brute(fps)
    rows = spark.createDataFrame([(x,) for x in fps], "fp bigint")
    for dense in (256, 4):
        monkeypatch.setattr(simhash, "DENSE", dense)
        found = {r["node"]: r["root"] for r in simhash.components(simhash.links(rows)).collect()}
        assert {x: found.get(x, x) for x in fps} == want


def test_odd_rows(docs):
    rows = simhash.near_duplicates(docs(*ODD)).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["component_id"] == by[2]["component_id"] == by[3]["component_id"] == 1 and by[1]["fp"] == 0
    assert by[5]["component_id"] == 4 and by[None]["component_id"] is None
    assert simhash.near_duplicates(docs(*ODD).limit(0)).count() == 0


def test_links_are_counted_alike_in_dense_buckets(spark, docs, monkeypatch):
    rng = random.Random(4)
    base = rng.getrandbits(64)
    fps = sorted({signed(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 2)))) for _ in range(60)})
    want = {(a, b) for a in fps for b in fps if a < b and bin((a ^ b) % (1 << 64)).count("1") <= 2}
    rows = spark.createDataFrame([(x,) for x in fps], "fp bigint")
    for dense in (256, 4):
        monkeypatch.setattr(simhash, "DENSE", dense)
        assert {(r["a"], r["b"]) for r in simhash.links(rows).collect()} == want


def test_joins_on_a_hot_fingerprint_are_split(spark):
    """The adaptive plan deals a key's rows out over several tasks; no setting of ours may turn that off."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(keep, ("20KB", "10KB", "-1", "40")):
            spark.conf.set(k, v)
        each = table(spark.range(200_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS fp"), "each")
        out = each.join(table(each.select("fp").distinct().withColumn("component_id", F.col("fp")), "found"), "fp")
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_variants_are_not_broadcast(spark):
    """Each fingerprint becomes 66 rows after Spark has taken its table's size: those rows must not go to the driver."""
    out = simhash.links(table(spark.range(2000).selectExpr("xxhash64(id) AS fp"), "fps"))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def joined_rows(df):
    """The rows that the joins of a collected frame made."""

    def of(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return of(node.executedPlan())
        if "QueryStage" in name:
            return of(node.plan())
        own = node.metrics().apply("numOutputRows").value() if "Join" in name else 0
        return own + sum(of(node.children().apply(k)) for k in range(node.children().size()))

    df.collect()
    return of(df._jdf.queryExecution().executedPlan())


def roots(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for start in sorted(near):
        todo = [] if start in out else [start]
        while todo:
            if (x := todo.pop()) not in out:
                out[x] = start
                todo += near[x]
    return out


def test_components_join_each_edge_once(spark, monkeypatch):
    """A dense group's links are not joined again in each round, nor when further links come."""
    rng, made, write = random.Random(4), [], simhash.table
    monkeypatch.setattr(simhash, "table", lambda df, name: (made.append(joined_rows(df)), write(df, name))[1])
    edges = [tuple(rng.sample(range(300), 2)) for _ in range(4000)] + [(k, k + 1) for k in range(1000, 1100)]
    more = [(5, 1050), (2000, 1001), (2000, 2001), (3000, 3001)]
    first = simhash.components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {r["node"]: r["root"] for r in first.collect()} == roots(edges)
    assert sum(made) < 3 * len(edges) + 4000  # one join for either end, and some of 401 nodes
    made.clear()
    both = simhash.components(spark.createDataFrame(more, "a bigint, b bigint"), first)
    assert both.columns == ["node", "root"] and {r["node"]: r["root"] for r in both.collect()} == roots(edges + more)
    assert sum(made) < 1000


def test_components_of_paths_and_odd_edges(spark):
    rng = random.Random(6)
    mixed = rng.sample(range(-500, 500), 300)
    for edges in ([], [(5, 5)], [(2, 1), (1, 2), (1, 2)], [(k, k + 1) for k in range(200)], list(zip(mixed, mixed[1:])), [(k, 999) for k in range(50)]):
        got = simhash.components(spark.createDataFrame(edges, "a bigint, b bigint"))
        assert got.columns == ["node", "root"] and {r["node"]: r["root"] for r in got.collect()} == roots(edges)
