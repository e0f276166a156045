"""Near duplicates by the Jaccard similarity of word shingles, as the SimHash operator verifies them.

A text is the set of its shingles' XXH64 hashes.  Pairs are proposed by the
deletion variants of the texts' fingerprints, which reach two bits, and, since
sets of similarity 0.8 differ in about ten bits, by minimum hashes, in keys of
some minima each: texts of similarity s share one of n keys of d minima with
probability ``1 - (1 - s ** d) ** n``, which at 0.8 leaves out three pairs in a
million, and the bits of their minima as many again.  Every proposed pair is verified with the whole sets before it links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, shuffled, table
from .simhash import components, hashes, links, majority

SEED = 42
#: Words of a shingle, and the least similarity of near duplicates.
SIZE, LEAST = 5, 0.8
#: Minima of a first key, and of a second one.
DEPTHS = (4, 8)
#: Pairs of just that similarity that share no key, and that differ in more bits than are compared further.
MISSED = 3e-6
#: Of a first key with more texts than DENSE each text is compared with PIVOTS texts of the key; of one with up to MANY
#: the marks of texts that this doesn't connect are compared too, and second keys do the rest.
DENSE, PIVOTS, MANY = 16, 3, 2048
#: Minima of which a bit is compared, and bits that stand for the shingles of a set.
BITS, MAP = 256, 1024
#: The columns of a set's bitmap.
MARKS = [f"m{k}" for k in range(MAP // 64)]
#: Shingles whose hashes are permuted at once.
BLOCK = 1 << 12


@lru_cache(8)
def permutations(depth: int, least: float = LEAST) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of keys, and what permutes hashes for their minima."""
    bands = math.ceil(math.log(MISSED) / math.log(1 - least**depth)) if least < 1 else 1
    found = np.random.default_rng((SEED, depth)).integers(0, 1 << 63, size=(2, depth * bands, 1), dtype=np.uint64)
    return bands, found[0] * np.uint64(2), found[1] * np.uint64(2) + np.uint64(1)


@lru_cache(8)
def differing(size: int, least: float = LEAST) -> int:
    """The most of so many bits, one a minimum, in which sets of that similarity differ, but for a share of MISSED."""
    odds, total, k = (1 - least) / 2, 0.0, -1
    while total < 1 - MISSED and k < size:
        k += 1
        total += math.comb(size, k) * odds**k * (1 - odds) ** (size - k)
    return k


def bitmap(own: np.ndarray) -> np.ndarray:
    """A bit for each shingle of a set, some sharing one, 64 to a long: no more bits differ than shingles do."""
    flags = np.zeros(MAP, np.uint8)
    flags[own % np.uint64(MAP)] = 1
    return np.packbits(flags, bitorder="little").view("<i8")


def shingles(text: bytes | None, size: int = SIZE) -> np.ndarray:
    """The distinct hashes of a UTF-8 text's shingles in order; of fewer words than size, one of all of them."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *hashes((text or b"").lower().split(), size)]))


def minima(own: np.ndarray, depth: int = DEPTHS[0], similar: float = LEAST) -> np.ndarray:
    """The least of a set's hashes by each permutation, in a row a key; an empty set has none."""
    if not len(own):
        return np.empty((0, depth), np.uint64)
    bands, flip, factor = permutations(depth, similar)
    least = np.full(depth * bands, np.iinfo(np.uint64).max)
    for at in range(0, len(own), BLOCK):
        least = np.minimum(least, ((own[at : at + BLOCK] ^ flip) * factor).min(axis=1))
    return least.reshape(bands, depth)


def keys(least: np.ndarray) -> np.ndarray:
    """A key for each row of minima."""
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), least.shape[1] << 32 | k) for k, x in enumerate(least)], np.uint64).view(np.int64)


def bits(least: np.ndarray) -> np.ndarray:
    """One bit of each of the first minima, 64 to a long: sets of similarity s agree in ``(1 + s) / 2`` of them."""
    low = least.reshape(-1)[:BITS]
    mixed = (low ^ (low >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(63)
    return np.packbits(np.pad(mixed.astype(np.uint8), (0, -len(mixed) % 64)), bitorder="little").view("<i8")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _lists(found: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate([*found, np.empty(0, np.int64)])))


def sketches(rows: DataFrame, size: int = SIZE, least: float = LEAST) -> DataFrame:
    """``row, whole, fp, keys, n, m0, ...`` of ``row, text``: a hash of the set of shingles, their fingerprint, the first keys, the set's size and bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wholes, fps, found, sizes, maps = [], [], [], [], []
            for x in batch.column(1).cast(pa.binary()):
                parts = list(hashes((x.as_py() or b"").lower().split(), size))
                own = np.unique(np.concatenate([np.empty(0, np.uint64), *parts]))
                wholes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                fps.append(majority(parts))
                found.append(keys(minima(own, DEPTHS[0], least)))
                sizes.append(len(own))
                maps.append(bitmap(own))
            whole, fp = (pa.array(np.array(v, np.uint64).view(np.int64)) for v in (wholes, fps))
            signs = np.array(maps, np.int64).reshape(-1, len(MARKS)).T.copy()
            columns = [batch.column(0), whole, fp, _lists(found), pa.array(sizes, pa.int64()), *map(pa.array, signs)]
            yield pa.record_batch(columns, names=["row", "whole", "fp", "keys", "n", *MARKS])

    return rows.mapInArrow(run, ", ".join(["row bigint, whole bigint, fp bigint, keys array<bigint>, n bigint", *(f"{x} bigint" for x in MARKS)]))


def _pairs(near: DataFrame) -> DataFrame:
    return near.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _apart(names: list[str]) -> str:
    return " + ".join(f"bit_count(a_{x} ^ {x})" for x in names)


def _allowed(least: float) -> str:
    """Whether ``n, m0, ...`` of two sets, one of them named ``a_n, a_m0, ...``, allow the similarity: they do of every similar pair."""
    return f"least(a_n, n) + 1e-9D >= {least!r}D * greatest(a_n, n) AND {_apart(MARKS)} <= {(1 - least) / (1 + least)!r}D * (a_n + n) + 1e-9D"


def possible(pairs: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """``a, b``: the pairs that the sizes and bitmaps of ``whole, n, m0, ...`` don't rule out; no similar pair is left out."""
    marks = sets.select("whole", "n", *MARKS)
    left = pairs.join(shuffled(marks.select(F.col("whole").alias("a"), *(F.col(x).alias(f"a_{x}") for x in ("n", *MARKS)))), "a")
    return left.join(shuffled(marks.withColumnRenamed("whole", "b")), "b").where(_allowed(least)).select("a", "b")


def close(sets: DataFrame) -> DataFrame:
    """``a, b``: of ``whole, fp``, a set for each fingerprint with the others of it, and with one of each within two bits."""
    firsts = table(sets.groupBy("fp").agg(F.min("whole").alias("a")), "firsts")
    same = sets.join(shuffled(firsts), "fp").selectExpr("a", "whole AS b")
    near = links(firsts.select("fp")).join(shuffled(firsts.selectExpr("fp AS a", "a AS x")), "a").join(shuffled(firsts.selectExpr("fp AS b", "a AS y")), "b")
    return _pairs(same.unionByName(near.selectExpr("x AS a", "y AS b")))


def candidates(shared: DataFrame) -> DataFrame:
    """``a, b``: of ``key, whole, n``, all pairs of keys with up to DENSE sets; of others, each set with PIVOTS sets that a hash of set and key picks."""
    small = shared.where(F.col("n") <= DENSE).select("key", "whole")
    near = small.withColumnRenamed("whole", "a").join(shuffled(small.withColumnRenamed("whole", "b")), "key").where("a < b").select("a", "b")
    big = shared.where(F.col("n") > DENSE).select("key", "whole")
    first = [F.min(F.struct(F.xxhash64("whole", "key", F.lit(k)).alias("h"), F.col("whole").alias("b")))["b"] for k in range(1, PIVOTS + 1)]
    # a table of its own, as below
    pivots = table(big.groupBy("key").agg(F.array(*first).alias("all")), "pivots")
    return near.unionByName(_pairs(big.join(shuffled(pivots), "key").select(F.col("whole").alias("a"), F.explode("all").alias("b"))))


def further(texts: DataFrame, roots: DataFrame, size: int = SIZE, least: float = LEAST, crowded: DataFrame | None = None) -> DataFrame:
    """``a, b``: of ``whole, text``, pairs of a crowded or second key that no group of ``node, root`` connects yet.

    Sets that share one of the crowded keys (``key, whole, n``) with up to MANY
    sets meet there; those of larger ones, and all if none are given, by second
    keys.  The sets of a key's largest group need no comparison with one another,
    so each set outside it meets the sets of other groups.  A pair is proposed if
    its sizes and bitmaps allow the similarity, which leaves out no similar pair,
    and if no more bits of its minima differ than similar sets have, but for
    MISSED of them: passages that many texts share give keys, but not pairs.
    """
    total = min(BITS, DEPTHS[1] * permutations(DEPTHS[1], least)[0])
    lows_of = [f"s{k}" for k in range(-(-total // 64))]
    marks = lows_of + MARKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x.as_py(), size) for x in batch.column(1).cast(pa.binary())]
            lows = [minima(x, DEPTHS[1], least) for x in sets]
            signs = [np.concatenate([bits(x) if len(x) else np.zeros(len(lows_of), np.int64), bitmap(own)]) for x, own in zip(lows, sets)]
            signs = np.array(signs, np.int64).reshape(-1, len(marks))
            columns = [batch.column(0), pa.array(np.fromiter(map(len, sets), np.int64, len(sets))), _lists(list(map(keys, lows))), *map(pa.array, signs.T.copy())]
            yield pa.record_batch(columns, names=["whole", "n", "keys", *marks])

    each = texts.mapInArrow(run, ", ".join(["whole bigint, n bigint, keys array<bigint>", *(f"{x} bigint" for x in marks)]))
    each = each.join(shuffled(roots.withColumnRenamed("node", "whole")), "whole", "left").withColumn("root", F.coalesce("root", "whole"))
    each = table(each, "second")

    def met(named: DataFrame) -> DataFrame:
        """The pairs of ``key, whole, root``."""
        named = table(named, "named")
        groups = named.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("most"), F.count("*").alias("groups")).where("groups > 1")
        # tables of their own: adaptive plans split a hot key only between two plain shuffles
        groups = table(groups.select("key", "most"), "groups")
        several = table(named.join(shuffled(groups), "key").join(shuffled(each.select("whole", "n", *marks)), "whole"), "several")
        left = several.where("root <> most").select("key", *(F.col(x).alias(f"a_{x}") for x in ("whole", "root", "n", *marks)))
        near = f"a_root <> root AND (root = most OR a_whole < whole) AND {_allowed(least)} AND {_apart(lows_of)} <= {differing(total, least)}"
        return _pairs(left.join(shuffled(several), "key").where(near).selectExpr("a_whole AS a", "whole AS b"))

    def second(some: DataFrame) -> DataFrame:
        return met(some.select(F.explode("keys").alias("key"), "whole", "root"))

    if crowded is None:
        return second(each)
    out = met(crowded.where(F.col("n") <= MANY).select("key", "whole").join(shuffled(each.select("whole", "root")), "whole").select("key", "whole", "root"))
    rest = crowded.where(F.col("n") > MANY).select("whole").distinct()
    return out if rest.isEmpty() else out.unionByName(second(each.join(shuffled(rest), "whole", "left_semi")))


def verified(pairs: DataFrame, texts: DataFrame, size: int = SIZE, least: float = LEAST) -> DataFrame:
    """``a, b``: the pairs whose sets, made from ``whole, text``, have at least that similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lru_cache(64)(lambda text: shingles(text, size))
        for batch in batches:
            x, y = (batch.column(k).cast(pa.binary()) for k in (2, 3))
            good = [similarity(own(s.as_py()), own(t.as_py())) >= least for s, t in zip(x, y)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(shuffled(texts.selectExpr("whole AS a", "text AS x")), "a").join(shuffled(texts.selectExpr("whole AS b", "text AS y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def keep_one(docs: DataFrame, size: int = SIZE, least: float = LEAST) -> DataFrame:
    """simhash.keep_one()."""
    rows = table(docs.withColumn("_pw_row", F.monotonically_increasing_id()), "rows")
    texts = rows.select(F.col("_pw_row").alias("row"), F.col("text").cast("string").alias("text"))
    each = table(sketches(texts, size, least), "sketches")
    sets = table(each.groupBy("whole").agg(F.min("row").alias("row"), *(F.first(x).alias(x) for x in ("fp", "keys", "n", *MARKS))), "sets")
    known = sets.select("whole", F.explode("keys").alias("key"))
    many = table(known.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    shared = table(known.join(shuffled(many), "key"), "shared")

    def texts_of(wholes: DataFrame) -> DataFrame:
        """``whole, text``: one row stands for all of a set, so the join of texts meets each row once."""
        return table(texts.join(shuffled(sets.select("whole", "row").join(shuffled(wholes.distinct()), "whole", "left_semi")), "row").select("whole", "text"), "texts")

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = table(pairs.distinct(), "pairs")
        own = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("whole")))
        out = table(verified(pairs, own, size, least), "links")
        forget(pairs, own)
        return out

    met = table(candidates(shared).unionByName(close(sets)).distinct(), "met")
    edges = linked(possible(met, sets, least))
    forget(met)
    roots = components(edges)
    dense = shared.where(F.col("n") > DENSE)
    if not dense.isEmpty():
        own = texts_of(dense.select("whole"))
        more = linked(further(own, roots, size, least, dense))
        forget(own)
        if not more.isEmpty():
            roots = components(more, roots)
    forget(many, shared, sets)
    roots = roots.selectExpr("node AS whole", "root")
    ids = table(rows.select(F.col("_pw_row").alias("row"), F.col("doc_id").alias("id")).where("id IS NOT NULL").join(shuffled(each.select("row", "whole")), "row"), "ids")
    firsts = ids.groupBy("whole").agg(F.min(F.struct("id", "row")).alias("first"))
    firsts = firsts.join(shuffled(roots), "whole", "left").groupBy(F.coalesce("root", "whole")).agg(F.min("first").alias("first"))
    kept = firsts.select(F.col("first.row").alias("_pw_kept"))
    led = rows.join(shuffled(kept), rows["_pw_row"] == kept["_pw_kept"], "left_semi")
    return led.select(*docs.columns).unionByName(rows.where("doc_id IS NULL").select(*docs.columns))
