"""Token ids of whole texts, through a bounded cache of what stands between blanks.

The vocabulary drops white space and no piece of it spans any, so a text's ids
are those of its blank-separated chunks in a row.  Chunks repeat, so each worker
keeps their ids and gives only unseen ones to the tokenizer, many at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Chunks of a generation; a worker keeps two, and what is used again moves from the older to the newer.
CACHE = 150_000
#: Longer chunks go to the tokenizer each time.
LONGEST = 64
#: Bytes of text that are encoded together at most.
PART = 1 << 22

#: Letters of the Latin-1 block, and marks behind them that are a token run of their own, whatever the word is.
_WORD = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:;=>?@\[-`{-~]*)")

#: The letters that a byte-level vocabulary writes for bytes that are no printable Latin-1 character.
_BYTES = {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if not (33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255))}


class Encoder:
    """``encode(text)`` gives what ``tokenizer.encode(text, add_special_tokens=False).ids`` does."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model  # each access makes an object
        self.octets = [k.to_bytes(4, "little") for k in range(1 + max(self.tokenizer.get_vocab().values(), default=0))]
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _age(self) -> None:
        if len(self.cache) > CACHE:
            self.cache, self.older = {}, self.cache

    def _word(self, word: str) -> bytes:
        """A lower-case Latin word that is one piece to the pre-tokenizer: the model alone decides."""
        text = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES)
        return b"".join([self.octets[x.id] for x in self.model.tokenize(text)])

    def _learn(self, chunks: set[str]) -> None:
        """Put chunks into the cache; words are encoded once for all their cases and marks."""
        cache, older, other = self.cache, self.older, []
        for chunk in chunks:
            if (ids := older.get(chunk)) is not None:
                cache[chunk] = ids
                continue
            if not (m := _WORD.fullmatch(chunk)):
                other.append(chunk)
                continue
            word, tail = m[1].lower(), m[2]
            if (ids := cache.get(word)) is None:
                if (ids := older.get(word)) is None:
                    ids = self._word(word)
                cache[word] = ids
            if tail:
                if (last := cache.get(tail)) is None:
                    last = cache[tail] = self._direct(tail)
                ids += last
            cache[chunk] = ids
        if plain := [x for x in other if "<|" not in x]:
            found = self.tokenizer.encode(plain, is_pretokenized=True, add_special_tokens=False)
            of, data = np.array(found.word_ids, dtype=np.int64), np.array(found.ids, dtype="<u4").tobytes()
            at = np.searchsorted(of, np.arange(len(plain) + 1)) * 4
            cache.update(zip(plain, (data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist()))))
        for chunk in other:
            if "<|" in chunk:
                cache[chunk] = self._direct(chunk)

    def _part(self, text: str) -> bytes:
        chunks = text.replace("\n", " ").split(" ")
        cache = self.cache
        try:
            return b"".join([cache[x] for x in chunks])
        except KeyError:
            pass
        self._age()
        cache = self.cache
        seen = set(chunks)
        long = {x for x in seen if len(x) > LONGEST}
        self._learn({x for x in seen if x not in cache} - long)
        if not long:
            return b"".join([cache[x] for x in chunks])
        return b"".join([self._direct(x) if x in long else cache[x] for x in chunks])

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids of a text as little-endian 32-bit integers, part by part."""
        while len(text) > PART:
            cut = max(text.rfind(" ", 1, PART), text.rfind("\n", 1, PART))
            cut = cut if cut > 0 else next((i for i in range(PART, len(text)) if text[i] in " \n"), len(text))
            yield self._part(text[:cut])
            text = text[cut:]
        yield self._part(text)

    def warm(self, texts: list[str]) -> None:
        """Learn the unseen chunks of a batch at once."""
        self._age()
        new: set[str] = set()
        for text in texts:
            if len(text) <= PART:
                new.update(text.replace("\n", " ").split(" "))
        new -= self.cache.keys()
        self._learn({x for x in new if len(x) <= LONGEST})

    def together(self, texts: pa.Array) -> tuple[np.ndarray, list[int]]:
        """The ids of texts of up to PART bytes in all, one text behind the other, and where each begins and the last ends.

        Each distinct chunk is looked up once; Arrow does the rest.
        """
        chunks = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = chunks.flatten().dictionary_encode()
        found = coded.dictionary.to_pylist()
        self._age()
        self._learn({x for x in found if x not in self.cache and len(x) <= LONGEST})
        ids = [self.cache[x] if len(x) <= LONGEST else self._direct(x) for x in found]
        ends = np.cumsum([0, *map(len, ids)]) // 4
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<u4")))
        at = np.concatenate(([0], np.cumsum(np.diff(ends)[coded.indices.to_numpy()])))
        return lists.take(coded.indices).flatten().to_numpy(), at[chunks.offsets.to_numpy()].tolist()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; ``path`` names a file of public_tokenizers, or is a whole path."""
    if path not in _encoders:
        where = path
        if "/" not in path:
            import public_tokenizers

            where = public_tokenizers.path(path)
        _encoders[path] = Encoder(where)
    return _encoders[path]


DEFAULT = "word_bpe_49k.json"
