"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's word
shingles.  Two fingerprints within ``2`` bits differ by at most one bit in one
of their two 32-bit segments, so both write the same one-wildcard variant of
that segment: an equality join on variants finds every such pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, shuffled, table

SEED = 42
BLOCK = 1 << 17
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def hashes(words: list[bytes], size: int) -> Iterator[np.ndarray]:
    """The hashes of the shingles of words, repeats included, some at a time; of fewer words than size, one of all of them."""
    size = min(size, len(words))
    for at in range(0, len(words) - size + 1 if words else 0, BLOCK):
        part = words[at : at + BLOCK + size - 1]
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
        starts = np.concatenate(([0], ends[: len(part) - size])).tolist()
        joined = b" ".join(part)
        shingles = [joined[a:b] for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())]
        yield np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))


def majority(parts: Iterable[np.ndarray]) -> int:
    """A bit is 1 if it is set in over half of all hashes."""
    total, counts = 0, np.zeros((8, 256), dtype=np.int64)
    for part in parts:
        octets = part.astype("<u8").view(np.uint8).reshape(-1, 8)
        total += len(part)
        for k in range(8):
            counts[k] += np.bincount(octets[:, k], minlength=256)
    ones = (counts @ _BITS).reshape(64)
    return int.from_bytes(np.packbits(ones * 2 > total, bitorder="little").tobytes(), "little")


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """The 64-bit fingerprint of a UTF-8 text; null and wordless texts have 0."""
    return majority(hashes((text or b"").lower().split(), size))


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """``doc_id, fp``: the fingerprint of each whole text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            values = np.fromiter((fingerprint(x.as_py(), size) for x in texts), np.uint64, len(texts))
            yield pa.record_batch([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {ids}, fp bigint")


#: A variant bucket with more members than this is linked through finer variants, not through pairs.
DENSE = 256


def _variants(fps: DataFrame) -> DataFrame:
    """``fp, wild, key, side``: 33 keys for either segment.

    ``wild`` 0-31 masks that bit (``side`` is its value), 32 masks none.  Rows
    of one key with other sides differ in exactly the masked bit.
    """
    # fingerprints are few bytes, so adaptive plans would put them into few tasks before each becomes 66 rows
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(65))).alias("k")).selectExpr(
        "fp", "k", "k % 33 AS wild", "CASE WHEN k < 33 THEN fp & 4294967295 ELSE shiftrightunsigned(fp, 32) END AS seg"
    )
    rows = rows.selectExpr("fp", "k", "wild", "seg", "CASE WHEN wild < 32 THEN shiftleft(1L, wild) ELSE 0L END AS bit")
    return rows.selectExpr(
        "fp", "wild", "shiftleft(CAST(k AS BIGINT), 32) | (seg & ~bit) AS key", "CASE WHEN wild < 32 THEN CAST((seg & bit) <> 0 AS INT) ELSE 2 END AS side"
    )


def links(fps: DataFrame) -> DataFrame:
    """``a, b``: pairs of distinct fingerprints within two bits.

    Buckets of up to DENSE members are compared pair by pair.  A larger one goes
    through finer variant groups, each of at most four distinct fingerprints, all
    within two bits of one another, so that its rows stay proportional to its
    members; every pair is in one of them.
    """
    rows = _variants(fps)
    big = rows.groupBy("key").count().where(F.col("count") > DENSE).select("key")
    small = rows.join(shuffled(big), "key", "left_anti")
    left = small.where("side <> 1").selectExpr("key", "fp AS a", "side")
    right = small.where("side <> 0").selectExpr("key", "fp AS b")
    near = left.join(shuffled(right), "key").where("(side = 0 OR a < b) AND bit_count(a ^ b) <= 2").selectExpr("least(a, b) AS a", "greatest(a, b) AS b")
    masks = {
        True: [(1 << i) | (1 << j) for i in range(32) for j in range(i)],
        False: [1 << i for i in range(32)],
    }
    fine = (
        rows.join(shuffled(big), "key", "left_semi")
        .selectExpr("fp", "key", "wild", "CASE WHEN shiftright(key, 32) < 33 THEN shiftrightunsigned(fp, 32) ELSE fp & 4294967295 END AS other")
        .withColumn("mask", F.explode(F.when(F.col("wild") == 32, F.array(*map(F.lit, masks[True]))).otherwise(F.array(*map(F.lit, masks[False])))))
        .groupBy("key", "mask", F.expr("other & ~mask").alias("rest"))
        .agg(F.collect_set("fp").alias("all"))
        .where("size(all) > 1")
        .select(F.explode("all").alias("a"), "all")
        .select("a", F.explode("all").alias("b"))
        .where("a < b")
    )
    return near.unionByName(fine).distinct()


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``node, root``: the least node reachable, for every node of an edge ``a, b``, and of known ones (``node, root``, of edges before these).

    Each round a node takes its least neighbour, if that is less, and then what
    that one has taken, until none changes; edges are carried over to what their
    ends have, and those within one node, and repeats, are gone before the next
    round.  A component's least node keeps itself, so it is the last one left.
    Tables in between are written to the shared folder.
    """
    return (_labels(edges) if known is None else _joined(known, edges)).select("node", "root")


def _labels(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.selectExpr("b AS a", "a AS b"))
    labels = table(both.groupBy("a").agg(F.min("b").alias("l")).selectExpr("a AS node", "least(a, l) AS root"), "labels")
    while True:
        jump = labels.selectExpr("node AS root", "root AS far")
        after = table(labels.join(shuffled(jump), "root").selectExpr("node", "far AS root", "root AS was"), "labels")
        forget(labels)
        labels = after
        if labels.where("root <> was").isEmpty():
            break
    out = _joined(labels, edges)
    if out is not labels:
        forget(labels)
    return out


def _joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels as edges join them, which are carried over to what their ends have; nodes without a label have themselves."""
    ends = edges.select("a", "b")
    for end in ("a", "b"):
        ends = ends.join(shuffled(labels.selectExpr(f"node AS {end}", f"root AS {end}_root")), end, "left")
    ends = ends.selectExpr("coalesce(a_root, a) AS x", "coalesce(b_root, b) AS y").where("x <> y")
    rest = table(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if rest.isEmpty():
        forget(rest)
        return labels
    later = _labels(rest)
    out = labels.join(shuffled(later.selectExpr("node AS root", "root AS far")), "root", "left").selectExpr("node", "coalesce(far, root) AS root")
    fresh = later.join(shuffled(labels.select("node")), "node", "left_anti").select("node", "root")
    out = table(out.unionByName(fresh), "labels")
    forget(rest, later)
    return out


def near_duplicates(docs: DataFrame, size: int = 3) -> DataFrame:
    """``doc_id, fp, component_id, links`` for every row of ``doc_id, text``.

    Null, empty and wordless texts have fingerprint 0 and are linked like any
    other; repeated rows stay repeated; null ids never name a component (it is
    null if it has no other); an empty table gives no rows; other columns are
    ignored.  ``links`` counts the other distinct fingerprints within two bits.
    Very long texts are read whole.
    """
    each = table(fingerprints(docs, size), "fingerprints")
    known = each.groupBy("fp").agg(F.min("doc_id").alias("first"))
    edges = table(links(known.select("fp")), "links")
    roots = components(edges)
    degree = edges.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("links"))
    known = table(known.join(shuffled(roots.withColumnRenamed("node", "fp")), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "known")
    # small sides as tables of their own: adaptive plans split a hot key only between two plain shuffles
    least = table(known.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    found = known.join(shuffled(least), "root").join(shuffled(degree), "fp", "left").select("fp", "component_id", F.coalesce("links", F.lit(0)).alias("links"))
    return each.join(shuffled(table(found, "found")), "fp").select("doc_id", "fp", "component_id", "links")


def keep_one(docs: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """The row of docs with the least id of each group of near duplicates; of rows of the group that repeat that id, one.

    Fingerprints within two bits propose pairs, and so do further keys for the
    similar texts that two bits don't reach; a pair links if the sets of all its
    word shingles have at least that similarity (``similar``).  Each row counts
    by its own text, whatever other rows have its id.  Null, empty and wordless
    texts are one group; very long ones are read whole.  Rows with a null id are
    kept, and lead no group; an empty table gives no rows.  All columns of docs
    are returned.
    """
    from . import similar

    return similar.keep_one(docs, size, least)
