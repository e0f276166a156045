import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest_llm import ODD
from tokenizers import Tokenizer

from panelworks.llm import lengths, packing, tokens

TOOL = Tokenizer.from_file(public_tokenizers.path(tokens.DEFAULT))


def ids(text):
    return np.array(TOOL.encode(text, add_special_tokens=False).ids, dtype="<u4")


@pytest.mark.parametrize("text", ["", " ", "It's a <|endoftext|> THE<|STARTOFTEXT|>..", "ΣΑΣ İx é 9²½ don't! x_y--'s", "éa ́ b", "tab\tand\r\nline nbsp　wide", "Straße ÀÉÎ÷×ß naïve,", "x" * 500, "!!!'s"])
def test_ids_are_the_tokenizers(text):
    tool = tokens.Encoder(public_tokenizers.path(tokens.DEFAULT))
    for _ in range(2):
        assert b"".join(tool.encode(text)) == ids(text).tobytes()


def test_parts_and_full_caches_change_nothing(monkeypatch):
    rng = random.Random(2)
    text = " ".join("".join(rng.choices("abcdeé.,'A1", k=rng.randint(1, 9))) for _ in range(3000))
    monkeypatch.setattr(tokens, "PART", 100)
    monkeypatch.setattr(tokens, "CACHE", 50)
    assert b"".join(tokens.Encoder(public_tokenizers.path(tokens.DEFAULT)).encode(text)) == ids(text).tobytes()


def test_plan_places_every_piece_once():
    rng = random.Random(1)
    for size in (10, 64, 2048):
        counts = Counter(rng.choices(range(1, size + 1), k=5000)) | Counter({size // 3: 4000})
        used, fill = Counter(), {}
        for length, first, count, start, each, offset in packing.plan(counts, size):
            assert first == used[length]
            used[length] += count
            for r in range(count):
                fill.setdefault(start + r // each, []).append((offset + r % each * length, length))
        assert used == counts and sorted(fill) == list(range(len(fill)))
        for parts in fill.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= size
        total = sum(k * n for k, n in counts.items())
        assert len(fill) <= 1.25 * (total // size + 1) + 1


def test_odd_rows(docs):
    df = docs(*ODD, (7, "a " * 2047), (8, "a " * 2048))
    rows = packing.pack(df).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for doc_id, text in [(1, ""), (2, ""), (5, ODD[6][1]), (6, ODD[7][1]), (7, "a " * 2047), (8, "a " * 2048)]:
        whole = np.append(ids(text), np.uint32(0)).astype("<u4")
        want = [(k, 2048 * k, len(x), zlib.crc32(x.tobytes())) for k in range(-(-len(whole) // 2048)) if len(x := whole[2048 * k : 2048 * (k + 1)])]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by[doc_id]) == want
    assert len(by[4]) == 2 and len(by[None]) == 1
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert at.get(r["sequence_id"], 0) == r["offset"]
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 2048 and packing.pack(df.limit(0)).count() == 0


def test_histogram_answers_every_limit(docs):
    df = docs(*ODD)
    sizes = [len(ids(t or "")) for _, t in ODD]
    rows = lengths.histogram(df).collect()
    for r in rows:
        n = r["length"]
        assert r["n_docs"] == sizes.count(n) and r["tokens"] == n * sizes.count(n)
        assert r["docs_from"] == sum(x >= n for x in sizes) and r["tokens_from"] == sum(x for x in sizes if x >= n)
        assert r["truncated_total"] == sum(min(x, n) for x in sizes) and r["share_to"] == pytest.approx(sum(x <= n for x in sizes) / len(sizes))
    got = {r["context"]: (r["whole_docs"], r["truncated_tokens"]) for r in lengths.answers(lengths.histogram(df), [1, 6, 100]).collect()}
    assert got == {c: (sum(x <= c for x in sizes), sum(min(x, c) for x in sizes)) for c in (1, 6, 100)}
    assert lengths.histogram(df.limit(0)).count() == 0


def test_texts_encoded_together_have_the_tokenizers_ids():
    rng, tool = random.Random(12), tokens.Encoder(public_tokenizers.path(tokens.DEFAULT))
    texts = [None, "", " \n", "a" * 300 + " b", "Éa, b!\tc <|x|> d\n\ne"] + [" ".join(rng.choice(("word", "Ünder", "x9-y", "z" * 70, "")) for _ in range(50)) for _ in range(20)]
    ids, at = tool.together(pa.array(["left out", *texts], pa.string()).slice(1))
    plain = Tokenizer.from_file(public_tokenizers.path(tokens.DEFAULT))
    assert len(at) == len(texts) + 1
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == plain.encode(text or "", add_special_tokens=False).ids
