"""Exact top-k inner products over a bit-sliced index.

Rows are indexed in blocks.  Each component of a block's vectors, made
non-negative and stripped of its lowest bits, is a stack of bitmaps, one per
bit.  For a query the stacks are added up, each shifted by the digits of the
query's weight, with bitmap arithmetic (full adders over 64 rows a word); the
k-th largest sum is read off from the most significant slice downward.  Rows
whose sum could still reach it, given what the stripped bits can add, are
resolved with exact integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, table

#: Bits kept of each component; rows, components and queries of a task at most.
KEEP, ROWS, CELLS, QUERIES = 6, 1 << 16, 1 << 23, 8192
#: Values of more bits are no 64-bit integers with room to subtract in; their rows are scored one by one.
WIDE = 61
#: Rows of like size share slices, so that a huge component doesn't coarsen those of other rows.
STEP, PLAIN = 6, 26


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as Python's integers, whatever their size; scale is a power of two."""
    return np.array([[int(np.floor(y)) if np.isfinite(y := x * scale) else int(x) * scale for x in row] for row in values.tolist()], dtype=object).reshape(values.shape)


def digits(weight: int) -> list[tuple[int, bool]]:
    """``(power of two, negative?)`` whose sum is weight, no two next to each other."""
    out, at, negative = [], 0, weight < 0
    weight = abs(weight)
    while weight:
        if weight & 1:
            minus = weight & 2 != 0
            out.append((at, minus != negative))
            weight += 1 if minus else -1
        weight >>= 1
        at += 1
    return out


class Block:
    """The index of vectors of one dimension, whose components are 64-bit integers below 2**WIDE."""

    def __init__(self, rows: np.ndarray, values: np.ndarray):
        self.rows, self.values = rows, values
        shifted = values - values.min(axis=0, initial=1 << WIDE)
        bits = int(shifted.max(initial=0)).bit_length()
        self.strip = max(0, bits - KEEP)
        self.bits = max(1, bits - self.strip)
        self.most = int(np.abs(values).max(initial=0))
        n = len(rows)
        self.words = -(-n // 64)
        padded = np.zeros((values.shape[1], self.words * 64), dtype=np.uint8)
        padded[:, :n] = (shifted >> self.strip).T
        self.slices = [[self._pack(own >> b & 1) for b in range(self.bits)] for own in padded]
        self.others = [[~x for x in own] for own in self.slices]
        self.valid = self._pack(np.arange(self.words * 64) < n)

    @staticmethod
    def _pack(bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits.astype(bool), bitorder="little").view(np.uint64)

    def sums(self, query: list[int]) -> list[np.ndarray]:
        """The slices, least first, of the weighted sum of all components, up to a constant (of negative digits: of the complement)."""
        levels: list[list[np.ndarray]] = []
        for own, other, weight in zip(self.slices, self.others, query):
            for at, negative in digits(weight):
                while len(levels) < at + self.bits:
                    levels.append([])
                for b, x in enumerate(other if negative else own):
                    levels[at + b].append(x)
        total = []
        k = 0
        while k < len(levels):
            level, at = levels[k], 0
            while len(level) - at > 1:
                if k + 1 == len(levels):
                    levels.append([])
                a, b = level[at], level[at + 1]
                either, both = a ^ b, a & b
                at += 2
                if at < len(level):
                    c = level[at]
                    both |= either & c
                    either ^= c
                    at += 1
                level.append(either)
                levels[k + 1].append(both)
            total.append(level[at] if at < len(level) else np.zeros(self.words, dtype=np.uint64))
            k += 1
        return total

    def top(self, own_row: int, query: list[int], k: int) -> list[tuple[int, int]]:
        """``(row, score)`` of rows among which the k best are, the query's own row left out."""
        valid = self.valid
        if len(own := np.flatnonzero(self.rows == own_row)):
            valid = valid & ~self._pack(np.isin(np.arange(self.words * 64), own))
        size = sum(map(abs, query))
        if int(np.bitwise_count(valid).sum()) > k and size:
            total = self.sums(query)
            among, need, threshold = valid, k, 0
            for b in range(len(total) - 1, -1, -1):
                ones = among & total[b]
                n = int(np.bitwise_count(ones).sum())
                if n >= need:
                    among, threshold = ones, threshold | 1 << b
                else:
                    need, among = need - n, among & ~total[b]
            # what the stripped bits of a row can add, in units of the sums
            threshold = max(0, threshold - (size * ((1 << self.strip) - 1) >> self.strip))
            above, among = np.zeros_like(valid), valid
            for b in range(len(total) - 1, -1, -1):
                if threshold >> b & 1:
                    among = among & total[b]
                else:
                    above, among = above | among & total[b], among & ~total[b]
            valid = above | among
        at = np.flatnonzero(np.unpackbits(valid.view(np.uint8), bitorder="little"))
        if size * self.most < 1 << 62:
            scores = self.values[at] @ np.array(query, dtype=np.int64)
        else:
            scores = self.values[at].astype(object) @ np.array(query, dtype=object)
        return list(zip(at.tolist(), scores.tolist()))


class Index:
    """Vectors of any dimensions and sizes: blocks of like rows, and rows too wide for slices."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: list[np.ndarray], scale: int):
        self.ids, self.scale = ids, scale
        groups: dict[tuple[int, int], list[int]] = {}
        for k, v in enumerate(vectors):
            size = int(np.frexp(np.abs(v).max(initial=0.0))[1]) + scale.bit_length()
            groups.setdefault((len(v), max(0, -(-(size - PLAIN) // STEP)) if size < WIDE else -1), []).append(k)
        self.parts: list[tuple[int, np.ndarray, Block | None, np.ndarray | None]] = []
        for (dim, kind), own in groups.items():
            at = np.array(own, dtype=np.int64)
            values = np.array([vectors[k] for k in own], dtype=np.float64).reshape(len(own), dim)
            if kind < 0:
                self.parts.append((dim, at, None, integers(values, scale)))
            else:
                self.parts.append((dim, at, Block(rows[at], np.floor(values * scale).astype(np.int64)), None))
        self.rows = rows

    def top(self, own_row: int, vector: np.ndarray, k: int) -> tuple[list[int], list[int]]:
        """``ids, scores`` of the k best, larger scores and then smaller ids first."""
        query = integers(vector[None, :], self.scale)[0].tolist()
        found: list[tuple[int, int]] = []
        for dim, at, block, wide in self.parts:
            if dim != len(query):
                continue
            if block is not None:
                found += [(-score, int(self.ids[at[j]])) for j, score in block.top(own_row, query, k)]
            else:
                found += [(-sum(a * b for a, b in zip(row, query)), int(self.ids[i])) for i, row in zip(at, wide) if self.rows[i] != own_row]
        best = sorted(found)[:k]
        return [i for _, i in best], [-s for s, _ in best]


def _vectors(rows: pa.Table) -> list[np.ndarray]:
    column = rows.column("v").combine_chunks()
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(flat, ends[:-1]) if len(ends) else []


def top_k(rows: DataFrame, asked: Column | str, k: int = 10, scale: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that is asked for, the k largest integer inner products of floor(scale * x) among all other rows.

    ``asked`` is a condition on ``vec_id``; scale is a power of two.  Ties go to
    the smaller vec_id; with fewer rows all are returned.  Vectors that are null
    or hold null or non-finite components, and null ids, take no part; only
    vectors of the query's dimension (0 too: every score is then 0) are
    compared.  Rows that repeat an id are rows of their own, as queries and as
    candidates: only the query's very row is left out.  A result beyond 64 bits
    raises.  An empty table gives no rows; other columns are ignored.

    Blocks of rows meet blocks of queries by an explicit key, both of bounded
    size however large the table, and each meeting gives k rows a query.
    """
    asked = F.expr(asked) if isinstance(asked, str) else asked
    v = F.col("embedding").cast("array<double>")
    whole = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL").where(F.forall("v", whole))
    rows = table(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, queries, dim = rows.agg(F.count("*"), F.count_if(asked), F.max(F.size("v"))).first()
    spread = partitions(rows.sparkSession)
    blocks = max(1, -(-n // max(1, min(ROWS, CELLS // max(1, dim or 1)))))
    groups = max(1, -(-queries // QUERIES), min(-(-queries // 64), -(-spread // blocks)))
    numbers = lambda n: F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))
    # the numbers of a partition's rows follow one another, so blocks are of like size
    left = rows.withColumn("block", F.pmod("row", F.lit(blocks).cast("bigint"))).withColumn("grp", F.explode(numbers(groups)))
    right = rows.where(asked).withColumn("grp", F.pmod("row", F.lit(groups).cast("bigint"))).withColumn("block", F.explode(numbers(blocks)))
    meet = max(spread, 2 * blocks * groups)
    left, right = (x.repartition(meet, "block", "grp").groupBy("block", "grp") for x in (left, right))

    def answer(own: pa.Table, wanted: pa.Table) -> pa.Table:
        out: list[tuple[list, list, list, list]] = []
        if len(own) and len(wanted):
            index = Index(own.column("row").to_numpy(), own.column("vec_id").to_numpy(), _vectors(own), scale)
            for row, query_id, vector in zip(wanted.column("row").to_pylist(), wanted.column("vec_id").to_pylist(), _vectors(wanted)):
                ids, scores = index.top(row, vector, k)
                if scores and scores[0] >= 1 << 63:
                    raise OverflowError(f"a score of vector {query_id} takes more than 64 bits")
                out.append(([row] * len(ids), [query_id] * len(ids), ids, [x if x >= -1 << 63 else None for x in scores]))
        columns = [[x for part in out for x in part[j]] for j in range(4)]
        return pa.table([pa.array(x, pa.int64()) for x in columns], names=["row", "query_id", "vec_id", "score"])

    found = left.cogroup(right).applyInArrow(answer, "row bigint, query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("row").orderBy(F.desc_nulls_last("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    score = F.coalesce("score", F.raise_error(F.lit("a score takes more than 64 bits")).cast("bigint"))
    return found.select("query_id", "rank", "vec_id", score.alias("score"))
