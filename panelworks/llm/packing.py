"""Best-fit packing planned on a histogram of lengths.

Documents become pieces of at most ``size`` ids.  Only the number of pieces of
each length is planned (at most ``size`` numbers, however many documents there
are); pieces then take planned slots by their rank within their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table
from .tokens import DEFAULT, PART, encoder

SIZE = 2048
END = 0
#: Ranks within a length are dealt out over this many groups, so that a frequent length is no single group.
GROUPS = 512


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts: ``(length, first, count, sequence, each, offset)``.

    Pieces of that length with ranks ``first`` to ``first + count - 1`` go, ``each``
    to a sequence and one behind the other from ``offset``, to sequences from
    ``sequence`` on.  Sequences with one history are handled as one range, so
    the work depends on the number of distinct lengths alone.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # space left -> ranges (first sequence, number)
    spaces: list[int] = []  # its keys in order
    out, fresh = [], 0

    def put(space: int, first: int, number: int) -> None:
        if number and space:
            if space not in room:
                insort(spaces, space)
            room[space].append((first, number))

    for length in sorted((k for k, n in counts.items() if n > 0), reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, number = room[space].pop()
                if not room[space]:
                    del room[space], spaces[at]
            else:
                space, first, number = size, fresh, -(-left // (size // length))
                fresh += number
            each = space // length
            full = min(number, left // each)
            if full:
                out.append((length, rank, full * each, first, each, size - space))
                put(space - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < number:
                if left and left < each:
                    out.append((length, rank, left, first + full, left, size - space))
                    put(space - left * length, first + full, 1)
                    full, rank, left = full + 1, rank + left, 0
                put(space, first + full, number - full)
    return out


def pieces(docs: DataFrame, size: int = SIZE, path: str = DEFAULT, end: int = END) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each whole text's ids and ``end``, cut only where longer than size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, last = encoder(path), end.to_bytes(4, "little")
        for batch in batches:
            texts, begin = batch.column(1), 0
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            while begin < len(sizes):
                stop, held = begin + 1, sizes[begin]
                while stop < len(sizes) and held + sizes[stop] <= PART:
                    held, stop = held + sizes[stop], stop + 1
                if held > PART:  # a text of its own, part by part
                    ids = np.frombuffer(b"".join(tool.encode(texts[begin].as_py())), "<u4")
                    ends = [0, len(ids)]
                else:
                    ids, ends = tool.together(texts.slice(begin, stop - begin))
                data = memoryview(np.ascontiguousarray(ids, "<u4").view(np.uint8))
                row, piece, start, length, crc = [], [], [], [], []
                for k in range(stop - begin):
                    total = ends[k + 1] - ends[k] + 1
                    for n, at in enumerate(range(0, total, size)):
                        many = min(size, total - at)
                        first = 4 * (ends[k] + at)
                        row.append(begin + k)
                        piece.append(n)
                        start.append(at)
                        length.append(many)
                        crc.append(zlib.crc32(data[first : first + 4 * many]) if at + many < total else zlib.crc32(last, zlib.crc32(data[first : 4 * ends[k + 1]])))
                yield pa.record_batch([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (piece, start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"]).cast(schema)
                begin = stop

    ids = docs.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("doc_id", to_arrow_type(ids)), ("piece", pa.int32()), *((x, pa.int64()) for x in ("start", "length", "ids_crc32"))])
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {ids.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(docs: DataFrame, size: int = SIZE, path: str = DEFAULT, end: int = END) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every row.

    Null and empty texts are a piece of the one id ``end``.  Rows that repeat
    are packed each; an empty table gives no rows; other columns are ignored.
    Equal lengths take slots in an order of no meaning that is the same each time.
    """
    each = pieces(docs, size, path, end).withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(GROUPS)))
    each = table(each, "pieces")
    groups = table(each.groupBy("length", "grp").agg(F.count("*").alias("n")), "groups")
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    slots: dict[int, list[tuple[int, int, int, int, int]]] = defaultdict(list)
    for length, *slot in plan(counts, size):
        slots[length].append(tuple(slot))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast({k: np.array(v, dtype=np.int64).T for k, v in slots.items()})
    before = groups.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "grp", F.coalesce("before", F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "grp").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = each.withColumn("rank", rank.cast("bigint") - 1).join(before, ["length", "grp"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (batch.column(k).to_numpy() for k in (3, 5))
            sequence, offset = np.empty_like(ranks), np.empty_like(ranks)
            for length in np.unique(lengths):
                own = np.flatnonzero(lengths == length)
                first, _, start, many, place_at = shared.value[int(length)]
                k = np.searchsorted(first, ranks[own], "right") - 1
                further = ranks[own] - first[k]
                sequence[own] = start[k] + further // many[k]
                offset[own] = place_at[k] + further % many[k] * length
            yield pa.record_batch([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {ids}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
