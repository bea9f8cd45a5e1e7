"""Token ids of whole texts by a public tokenizer, batch by batch.

White space ends a token in this vocabulary, so a text's ids are those of its
blank-separated chunks in a row. Chunks repeat, so each of a few texts
(``encode.CHUNK``) is cut up once: letters and the marks after them by Arrow's kernels, other
plain chunks by the vocabulary's own pattern, and anything unusual is left to
the tokenizer as it stands. Words' ids are kept in a bounded memo of each worker.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .encode import CACHES, encoded, tidy

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Entries of a worker's memos of words and of odd chunks, some 130 bytes each.
MEMO, ODD = 170_000, 30_000
#: Fixed value: how the vocabulary file's pre-tokenizer cuts a text.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
PLAIN = regex.compile(r"[!-~¡-ͯ]+")
LAST_PLAIN = "ͯ"
#: Marks that may stand after a word as one piece; an apostrophe may begin a piece of its own.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters whose lower case is one of them too, and which normalisation leaves alone.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The usual byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Memo(dict):
    """A dict that makes missing values, and forgets the older half when it is full."""

    def __init__(self, make, most: int = MEMO) -> None:
        super().__init__()
        self.make, self.most, self.old = make, max(1, most // 2), {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if len(key) <= 64:
            self[key] = value
        return value


class ChunkTokenizer:
    """text -> ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.words = Memo(self._word)
        self.chunks = Memo(self._chunk, ODD)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        alike = "Don't stop:éÜß ¿qué? x_1 "
        self.fast = self.of(alike) == self._whole(alike)

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if word.isascii():
            mapped = word
        else:
            mapped = "".join(map(self.letters.__getitem__, word.encode()))
        return np.asarray([t.id for t in self.model.tokenize(mapped)], dtype="<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        # Letters, or letters and then marks: the pattern cuts them just so.
        body = chunk.rstrip(MARKS)
        if body.isalpha() and max(chunk) <= LAST_PLAIN:
            low = body.lower()
            if low.isalpha():
                return self.words[low] + self.words[chunk[len(body) :]] if len(body) < len(chunk) else self.words[low]
        if not PLAIN.fullmatch(chunk) or "<|" in chunk and any(s in chunk for s in self.special):
            return self._whole(chunk)
        plain = chunk.lower() if chunk.isascii() else unicodedata.normalize("NFC", chunk).lower()
        return b"".join(map(self.words.__getitem__, PATTERN.findall(plain)))

    def of(self, text: str) -> bytes:
        if not getattr(self, "fast", True):
            return self._whole(text)
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))

    def _distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``chunks`` in a row, and how many each has."""
        n = len(chunks)
        worded = pc.match_substring_regex(chunks, f"^[{LETTERS}]+[{re.escape(MARKS)}]*$")
        plain, at = chunks.filter(worded), np.flatnonzero(np.asarray(worded))
        words = pc.utf8_lower(pc.utf8_rtrim(plain, characters=MARKS)).dictionary_encode()
        marks = pc.replace_substring_regex(plain, f"^[{LETTERS}]+", "").dictionary_encode()
        others = chunks.filter(pc.invert(worded)).to_pylist()
        parts = [self.words[w] for w in words.dictionary.to_pylist()]
        first, second = np.zeros(n, np.int64), np.full(n, -1)
        first[at], second[at] = np.asarray(words.indices), len(parts) + np.asarray(marks.indices).astype(np.int64)
        parts += [self.words[m] if m else b"" for m in marks.dictionary.to_pylist()]
        first[~np.asarray(worded)] = len(parts) + np.arange(len(others))
        parts += map(self.chunks.__getitem__, others)
        second[second < 0] = len(parts)
        parts.append(b"")
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        ids, each = _gathered(np.frombuffer(b"".join(parts), "<u4"), lengths, np.column_stack([first, second]).ravel())
        return ids, each.reshape(-1, 2).sum(axis=1)

    def of_all(self, texts: pa.Array) -> Iterator[bytes]:
        """``of`` each text, or of an empty one for null."""
        if not self.fast:
            yield from (self.of(t or "") for t in texts.to_pylist())
            return
        for e in encoded(texts, lambda x: pc.split_pattern(pc.replace_substring(x, "\n", " "), " ")):
            ids, each = _gathered(*self._distinct(e.words), e.codes)
            ends = np.append(0, np.cumsum(each))[np.append(0, e.ends)]
            yield from (ids[a:b].tobytes() for a, b in pairwise(ends.tolist()))


def _gathered(values: np.ndarray, lengths: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ``values``, cut into runs of ``lengths``, the runs numbered ``chosen`` in a row, and their lengths."""
    each = lengths[chosen]
    before = (np.cumsum(lengths) - lengths)[chosen] - (np.cumsum(each) - each)
    kind = np.int32 if each.sum() < 1 << 31 > len(values) else np.int64  # half the memory, for all but giant texts
    at = np.repeat(before.astype(kind), each)
    at += np.arange(len(at), dtype=kind)
    return values[at], each


@lru_cache(maxsize=1)
def chunk_tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


CACHES["tokens"] = chunk_tokenizer.cache_clear


def tokenized_pieces(docs: DataFrame, tokenizer: str | None, capacity: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and ``end_id``, cut every ``capacity`` ids."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = chunk_tokenizer(path), np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            ids, piece, start, length, crc = [], [], [], [], []
            for doc_id, data in zip(batch.column(0).to_pylist(), tok.of_all(batch.column(1)), strict=True):
                data += end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    ids.append(doc_id)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            del batch  # not kept while the next batch is read
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(tidy(run, "tokens"), PIECES)
