"""Token ids of whole columns of texts: each distinct word goes through the tokenizers library once per worker."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa

from skyledger.llm.common import hold, span_hashes, spans, steps, string_bytes

#: A worker forgets its words when it knows so many.
MAX_WORDS = 500_000
_STEP = 1 << 19
#: New words that go to the library as one text.
_JOINED_WORDS = 256

# Byte classes: 0 white space, 1 letters a-z and two-byte letters of Latin-1, 2 digits, 3 other ASCII signs.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[0x20, 0x09, 0x0A, 0x0D]] = 0
_CLASS[0x61:0x7B] = 1
_CLASS[0x80:0xC0] = 1
_CLASS[0xC3] = 1
_CLASS[0x30:0x3A] = 2
# Words with any other byte, an apostrophe (contractions) or "<" (special tokens) go to the tokenizer as they are.
_ODD = np.ones(256, bool)
_ODD[[0x20, 0x09, 0x0A, 0x0D]] = False
_ODD[0x21:0x7F] = False
_ODD[0x80:0xC0] = False
_ODD[0xC3] = False
_ODD[[0x27, 0x3C]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: The arrangement for which words may be split and lower-cased here (fixed value of the vocabulary file).
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class Coder:
    """Encodes columns of texts with the tokenizer of ``path``, without special tokens; NULL is the empty text.

    If the tokenizer drops white space and splits words by the usual pattern, a text is cut into words and pieces on its bytes, each new
    piece is encoded by the library, and its ids are reused.  Any other tokenizer encodes whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        with open(path) as file:
            shape = json.load(file)
        kinds = [x["type"] for x in (shape.get("normalizer") or {}).get("normalizers", [])]
        parts = (shape.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.by_word = kinds == ["NFC", "Replace", "Lowercase"] and parts[0].get("pattern") == {"Regex": _SPLIT} and len(parts) == 2 and shape.get("post_processor") is None
        if self.by_word:
            self.lean = Tokenizer(self.full.model)  # shares the vocabulary
            self.lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            blank = self.lean.encode(" ", add_special_tokens=False).ids
            self.by_word = len(blank) == 1 and self.lean.id_to_token(blank[0]).startswith("Ġ")  # the sign for a blank, which no word holds
            self.blank = blank[0] if self.by_word else -1
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.pool, self.starts, self.lengths = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def encode(self, column: pa.Array, step: int = _STEP) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """First row, end row, ids and the rows' offsets into them, for rows of ``step`` bytes at a time."""
        data, at = string_bytes(column)
        for row, end in steps(at, step):
            part, inner = data[at[row] : at[end]], at[row : end + 1] - at[row]
            if self.by_word:
                ids, offsets = self._words(part, inner)
            else:
                got = [x.ids for x in self.full.encode_batch_fast([bytes(part[a:b]).decode() for a, b in zip(inner, inner[1:], strict=False)], add_special_tokens=False)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int64)
                ids = np.fromiter((i for x in got for i in x), np.int32, int(offsets[-1]))
            yield row, end, ids, offsets

    def _words(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = _LOWER[data]
        follow = np.flatnonzero(data[:-1] == 0xC3) + 1
        second = data[follow]
        low[follow] = np.where((second < 0x9F) & (second != 0x97), second + 0x20, second)
        kind = _CLASS[low]
        solid = kind != 0
        chunk_starts, chunk_ends = spans(solid, at[:-1])
        if not len(chunk_starts):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        odd = _ODD[data]
        odd[follow] |= (second == 0x97) | (second == 0xB7)
        begin = np.zeros(len(data) + 1, bool)
        begin[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        begin[:-1] &= solid
        begin[chunk_starts] = True
        sums = np.concatenate([[0], np.cumsum(odd)])
        strange = sums[chunk_ends] > sums[chunk_starts]
        raw = None
        if strange.any():
            edges = np.zeros(len(data) + 1, np.int8)
            edges[chunk_starts[strange]] += 1
            edges[chunk_ends[strange]] -= 1
            inside = np.cumsum(edges[:-1]) > 0
            begin[:-1] &= ~inside
            begin[chunk_starts] = True
            raw = inside
        starts = np.flatnonzero(begin[:-1])
        stop = begin[1:].copy()
        stop[:-1] |= ~solid[1:]
        stop[-1] = True
        ends = np.flatnonzero(solid & stop) + 1
        hashes = span_hashes(low, starts, ends)
        if raw is not None:
            whole = raw[starts]
            hashes[whole] = ~span_hashes(data, starts[whole], ends[whole])
        coded = pa.array(hashes).dictionary_encode()
        index, keys = coded.indices.to_numpy(), coded.dictionary.to_numpy().tolist()
        if len(self.known) + len(keys) > MAX_WORDS:
            self._forget()
        slots = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(slots < 0)
        if len(new):
            first = np.empty(len(keys), np.int64)
            first[index[::-1]] = np.arange(len(index))[::-1]
            self._learn([keys[i] for i in new], first[new], starts, ends, low, data, raw)
            slots[new] = np.arange(len(self.known) - len(new), len(self.known))
        slots = slots[index]
        lengths = self.lengths[slots]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.pool[np.repeat(self.starts[slots] - sums[:-1], lengths) + np.arange(sums[-1])]
        return ids, sums[np.searchsorted(starts, at)]

    def _learn(self, keys: list[int], first: np.ndarray, starts: np.ndarray, ends: np.ndarray, low: np.ndarray, data: np.ndarray, raw: np.ndarray | None) -> None:
        whole = raw[starts[first]] if raw is not None else np.zeros(len(first), bool)
        lengths, at = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        parts, used = [], 0
        for encode, source, rows in ((self._lean_words, low, np.flatnonzero(~whole)), (self._raw_words, data, np.flatnonzero(whole))):
            if len(rows):
                ids, sizes = encode(source, starts[first[rows]], ends[first[rows]])
                lengths[rows], at[rows] = sizes, used + np.cumsum(sizes) - sizes
                parts.append(ids)
                used += len(ids)
        flat = np.concatenate(parts)
        n, known = self.used + len(flat), len(self.known)
        while len(self.pool) < n:
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while len(self.starts) < known + len(first):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.pool[self.used : n] = flat
        self.lengths[known : known + len(first)] = lengths
        self.starts[known : known + len(first)] = self.used + at
        self.used = n
        self.known.update(zip(keys, range(known, known + len(first)), strict=True))

    def _raw_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and how many each has."""
        texts = [bytes(data[a:b]).decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        got = [x.ids for x in self.full.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((i for x in got for i in x), np.int32, int(lengths.sum())), lengths

    def _lean_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for words without blanks: many go to the library as one text, since every call has its price, and the blanks' ids part them."""
        sizes = ends - starts + 1
        sums = np.concatenate([[0], np.cumsum(sizes)])
        joined = data[np.minimum(np.repeat(starts - sums[:-1], sizes) + np.arange(sums[-1]), len(data) - 1)]
        joined[sums[1:] - 1] = 0x20
        edges = np.append(sums[:-1:_JOINED_WORDS], sums[-1]).tolist()
        texts = [joined[a:b].tobytes().decode() for a, b in zip(edges, edges[1:], strict=False)]
        ids = np.concatenate([np.array(x.ids, np.int32) for x in self.lean.encode_batch_fast(texts, add_special_tokens=False)])
        blank = ids == self.blank
        lengths = np.diff(np.flatnonzero(blank), prepend=-1) - 1
        return ids[~blank], lengths


_CODERS: dict[str, Coder] = hold({})


def coder(path: str) -> Coder:
    """The worker's coder for a vocabulary file; it outlives a task, so its words do, too, until another operator needs the memory."""
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]
