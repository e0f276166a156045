"""Benchmark decontamination by pigeonhole edit matching.

A test item of n words may be off by ``k = floor(rate * n)`` word edits.  It is
cut into k + 1 pieces, of which a match within k edits holds one unchanged (of
fewer than ``1 / rate`` words the one piece is the item); an automaton finds the
pieces' exact hits, and Myers' bit-parallel distance (words as symbols) verifies
the windows that the hits imply, once over each stretch of a document.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 0.2
#: Characters of items that are broadcast at once; more items make more passes over the documents.
BLOCK = 4_000_000

_WORDS = re.compile(r"\w+")
#: Characters of scripts that are written without blanks (Thai to Khmer, kana, Han), each of which is a word.
_DENSE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_SOME = re.compile(f"[{_DENSE}]")
_MIXED = re.compile(rf"[{_DENSE}]|(?:(?![{_DENSE}])\w)+")


def words(text: str | None) -> list[str]:
    text = (text or "").lower()
    return (_MIXED if not text.isascii() and _SOME.search(text) else _WORDS).findall(text)


def myers(pattern: list[str], text: list[str], limit: int) -> tuple[int, int] | None:
    """``(distance, end)`` of the closest place in text (the first of equals), or None beyond limit."""
    masks: dict[str, int] = {}
    for i, word in enumerate(pattern):
        masks[word] = masks.get(word, 0) | 1 << i
    n = len(pattern)
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best = full, 0, n, (limit + 1, -1)
    for end, word in enumerate(text):
        eq = masks.get(word, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | ~(xh | plus) & full, plus & xh
        score += (ph & top != 0) - (mh & top != 0)
        ph, mh = ph << 1 & full, mh << 1 & full
        plus, minus = mh | ~(xv | ph) & full, ph & xv
        if score < best[0]:
            best = (score, end)
    return None if best[1] < 0 else best


class Finder:
    """The items of one block, and their pieces in an automaton."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        self.items: list[tuple[object, list[str], int]] = []
        self.pieces = ahocorasick.Automaton()
        found: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            if not (own := words(text)):
                continue
            limit = int(rate * len(own))
            for k in range(limit + 1):
                at, to = k * len(own) // (limit + 1), (k + 1) * len(own) // (limit + 1)
                found.setdefault(f" {' '.join(own[at:to])} ", []).append((len(self.items), at))
            self.items.append((item_id, own, limit))
        for piece, places in found.items():
            self.pieces.add_word(piece, (len(piece), places))
        if found:
            self.pieces.make_automaton()

    def find(self, text: str | None) -> list[tuple[object, int, int, int, int]]:
        """``(item_id, distance, budget, first word, last word)``: each item's closest match in the text."""
        own = words(text)
        if not self.items or not own:
            return []
        starts: list[int] = []
        windows: dict[int, list[list[int]]] = {}
        joined = " ".join(own)
        for at, (size, places) in self.pieces.iter(f" {joined} "):
            if not starts:
                place = 0
                for word in own:
                    starts.append(place)
                    place += len(word) + 1
            first = bisect_left(starts, at - size + 1)
            for k, offset in places:
                _, item, limit = self.items[k]
                window = [max(0, first - offset - limit), first - offset + len(item) + limit]
                # hits come in order, so only the last windows can meet a new one
                known = windows.setdefault(k, [])
                while known and window[0] <= known[-1][1]:
                    low, high = known.pop()
                    window = [min(low, window[0]), max(high, window[1])]
                known.append(window)
        out, best = [], {}
        for k, known in windows.items():
            _, item, limit = self.items[k]
            for low, high in known:
                if k in best and not best[k][0]:
                    break
                if (hit := myers(item, own[low:high], min(limit, best[k][0] - 1) if k in best else limit)) is not None:
                    best[k] = (hit[0], low + hit[1])
        for k, (distance, end) in best.items():
            item_id, item, limit = self.items[k]
            low = max(0, end + 1 - len(item) - distance)
            back = myers(item[::-1], own[low : end + 1][::-1], limit)
            out.append((item_id, distance, limit, end - back[1] if back else low, end))
        return out


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, str]]]:
    block, size = [], 0
    for row in benchmark.select("item_id", F.col("text").cast("string")).where("item_id IS NOT NULL AND text IS NOT NULL").dropDuplicates().toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1])
        if size >= BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


_finders: dict[object, Finder] = {}


def _finder(shared, rate: float) -> Finder:
    """One automaton for each block in a worker."""
    if shared.id not in _finders:
        _finders.clear()
        _finders[shared.id] = Finder(shared.value, rate)
    return _finders[shared.id]


class _Shared:
    def __init__(self, spark, items):
        import uuid

        self.id, self.inner = uuid.uuid4().hex, spark.sparkContext.broadcast(items)

    @property
    def value(self):
        return self.inner.value


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """``doc_id, item_id, distance, budget, first_word, last_word`` for each document and each item that it holds.

    Letters' case, marks and white space don't count; of equally close places the
    first counts.  Items of any number of words are found inside longer texts.
    Null and empty texts hold nothing; very long ones are searched whole; items
    that are null or have no word match nothing; documents that repeat an id give
    rows each, items that repeat an id with other texts too; an empty table gives
    no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ids, items = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType
    schema = f"doc_id {ids}, item_id {items.simpleString()}, distance int, budget int, first_word int, last_word int"
    out = spark.createDataFrame([], schema)
    for block in _blocks(benchmark):
        shared = _Shared(spark, block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = _finder(shared, rate)
            for batch in batches:
                rows, cells = [], []
                for k, text in enumerate(batch.column(1)):
                    for hit in finder.find(text.as_py()):
                        rows.append(k)
                        cells.append(hit)
                columns = list(zip(*cells)) or [()] * 5
                made = [pa.array(columns[0])] if cells else [pa.nulls(0)]
                yield pa.record_batch([batch.column(0).take(pa.array(rows, pa.int64())), made[0].cast(kind), *(pa.array(x, pa.int32()) for x in columns[1:])], names=["doc_id", "item_id", "distance", "budget", "first_word", "last_word"])

        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(items)
        out = out.unionByName(docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of docs whose text holds no item, with all their columns, as leaks() finds them.

    Null and empty texts stay; rows that repeat stay or go each by its own text;
    without documents or items nothing goes.
    """
    at = docs.columns.index("text")
    for block in _blocks(benchmark):
        shared = _Shared(docs.sparkSession, block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = _finder(shared, rate)
            for batch in batches:
                yield batch.filter(pa.array([not finder.find(x.as_py()) for x in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
