"""Byte-level BPE inside a task: splitting, ids and exact prefix counts.

Texts are split into words by array operations over whole batches, the distinct
words of a batch are encoded once and cached per worker, and the results are
gathered back by index. The vocabulary file is a parameter everywhere.

Prefix counts use dynamic programming over the bytes of a word: the encoding of a
prefix ends in the one token ``t`` that is a suffix of the prefix and forms a
stable pair with the last token of the encoding of what precedes it, so
``count[i] = count[i - len(t)] + 1``.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import tiktoken

# White space as Unicode's White_Space property has it (fixed values).
SPACES = [0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006,
          0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

# Contraction endings that the splitter keeps together with their apostrophe (fixed values).
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]

CHUNK_CHARS = 1 << 20
CACHE_WORDS = 300_000
CACHE_PAIRS = 2_000_000
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


@functools.cache
def _classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    table[SPACES] = SPACE
    return table


def _byte_of_char() -> dict[str, int]:
    """The printable stand-in characters of byte-level vocabularies, by rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Splits:
    """Word boundaries of a batch of pieces.

    ``cp`` the code points of all pieces, ``start`` true where a word starts,
    ``byte_at`` each code point's first byte (one more entry than code points),
    ``runs`` the (start, end) of white-space runs of two or more before another
    character, ``inner`` the second characters of three-character contractions.
    """

    def __init__(self, strings: list[str]):
        joined = "".join(strings)
        self.data = joined.encode()
        self.cp = cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        n = len(cp)
        self.ends = np.cumsum([len(s) for s in strings])
        wide = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
        self.byte_at = np.concatenate([[0], np.cumsum(wide)])
        first = np.zeros(n + 1, bool)
        first[0] = True
        first[self.ends] = True
        kind = _classes()[cp]
        start = first.copy()
        start[1:n] |= kind[1:] != kind[:-1]
        is_space = kind == SPACE
        last = np.zeros(n, bool)
        last[:-1] = is_space[:-1] & ~is_space[1:] & ~first[1:n]
        run_start = np.flatnonzero(is_space & start[:n])
        last_at = np.flatnonzero(last)
        begins = run_start[np.searchsorted(run_start, last_at, side="right") - 1]
        long_run = begins < last_at
        self.runs = np.column_stack([begins[long_run], last_at[long_run] + 1])
        start[last_at] = True
        start[last_at[cp[last_at] == 0x20] + 1] = False
        inner = []
        for i in np.flatnonzero((cp == 0x27) & start[:n]):
            for ending in ENDINGS:
                k = len(ending)
                if joined.startswith(ending, int(i) + 1) and not first[i + 1 : i + 1 + k].any():
                    start[i + 1 : i + 1 + k] = False
                    start[i + 1 + k] = True
                    if k == 2:
                        inner.append(int(i) + 1)
                    break
        self.inner = np.array(inner, np.int64)
        self.start = start
        self.word_at = np.flatnonzero(start[:n])

    def words(self) -> pa.Array:
        offsets = np.append(self.byte_at[self.word_at], len(self.data)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(self.data)])


class ByteBpe:
    """A byte-level vocabulary file with its encoder, word cache and prefix counter."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = _byte_of_char()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.rank = {bytes(map(to_byte.__getitem__, k)): v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        self._core = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=self.rank, special_tokens=self.special)
        self._longest = max(map(len, self.rank))
        self._token = {v: k for k, v in self.rank.items()}
        self._pairs: dict[int, bool] = {}
        self._ids: dict[bytes, list[int]] = {}
        self._counts: dict[bytes, list[int]] = {}
        self._specials = re.compile("(" + "|".join(re.escape(s) for s in self.special) + ")") if self.special else None

    def pieces(self, text: str) -> Iterator[tuple[str, str]]:
        """A text as (ordinary piece, special string after it or ''); long pieces are cut where a word surely ends."""
        parts = self._specials.split(text) if self._specials and any(s in text for s in self.special) else [text]
        for i in range(0, len(parts), 2):
            piece, mark = parts[i], parts[i + 1] if i + 1 < len(parts) else ""
            at = 0
            while len(piece) - at > CHUNK_CHARS and (cut := _SAFE_CUT.search(piece, at + CHUNK_CHARS // 2)):
                yield piece[at : cut.start()], ""
                at = cut.start()
            yield piece[at:] if at else piece, mark

    def _encode(self, word: bytes) -> list[int]:
        return self._core._encode_single_piece(word)

    def _encode_words(self, words: list[bytes]) -> list[list[int]]:
        return [self._core._encode_single_piece(w) for w in words]

    def _stable(self, left: int, right: int) -> bool:
        """True if ``left right`` is how the encoder writes the two tokens' bytes (left -1: nothing)."""
        key = (left + 1) << 20 | right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > CACHE_PAIRS:
                self._pairs.clear()
            if left < 0:
                known = self._encode(self._token[right]) == [right]
            else:
                known = self._encode(self._token[left] + self._token[right]) == [left, right]
            self._pairs[key] = known
        return known

    def prefix_counts(self, word: bytes) -> list[int]:
        """Tokens of every byte prefix of one word, the empty prefix left out."""
        return self._count_words([word])[0]

    def _count_words(self, words: list[bytes]) -> list[list[int]]:
        """Prefix counts of many words; in sorted order a word starts from what its predecessor shares with it."""
        rank, stable, longest = self.rank, self._stable, self._longest
        order = sorted(range(len(words)), key=words.__getitem__)
        out: list[list[int]] = [[]] * len(words)
        last, count, previous = [-1], [0], b""
        for at in order:
            word = words[at]
            shared = len(commonprefix((previous, word)))
            del last[shared + 1 :], count[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                for k in range(max(0, i - longest), i):
                    token = rank.get(word[k:i])
                    if token is not None and stable(last[k], token):
                        last.append(token)
                        count.append(count[k] + 1)
                        break
            out[at] = count[1:]
            previous = word
        return out

    def _gather(self, words: pa.Array, cache: dict[bytes, list[int]], make) -> tuple[np.ndarray, np.ndarray]:
        """Per word its values' number, and all values in word order."""
        coded = words.dictionary_encode()
        if len(cache) > CACHE_WORDS:
            cache.clear()
        distinct = coded.dictionary.to_pylist()
        missing = [w for w in distinct if w not in cache]
        cache.update(zip(missing, make(missing)))
        values = [cache[w] for w in distinct]
        index = coded.indices.to_numpy()
        size = np.fromiter(map(len, values), np.int64, len(values))
        flat = np.fromiter(chain.from_iterable(values), np.int64, int(size.sum()))
        at = np.cumsum(size) - size
        n = size[index]
        shift = at[index] - (np.cumsum(n) - n)
        return n, flat[np.repeat(shift, n) + np.arange(int(n.sum()))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        return self._chunked(texts, self._encode_chunk, self._add_special_id)

    def counts(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the exact token count of every prefix of 1, 2, ... code points."""
        return self._chunked(texts, self._count_chunk, None)

    def _chunked(self, texts, run, special) -> list[np.ndarray]:
        out: list[list[np.ndarray]] = [[] for _ in texts]
        strings, owners, marks, chars = [], [], [], 0
        for k, text in enumerate(texts):
            for piece, mark in self.pieces(text):
                strings.append(piece)
                owners.append(k)
                marks.append(mark)
                chars += len(piece)
                if chars >= CHUNK_CHARS:
                    self._flush(out, strings, owners, marks, run, special)
                    strings, owners, marks, chars = [], [], [], 0
        self._flush(out, strings, owners, marks, run, special)
        if special is None:
            return [_running(parts) for parts in out]
        return [np.concatenate(parts) if parts else np.zeros(0, np.int64) for parts in out]

    def _flush(self, out, strings, owners, marks, run, special) -> None:
        if special is None:
            strings = [s + m for s, m in zip(strings, marks)]
        got = run(strings)
        for k, values, mark in zip(owners, got, marks):
            if mark and special is None:
                # Inside the special string the prefix is ordinary text; with its last character it is one token.
                inner = len(values) - len(mark)
                values = values.copy()
                values[-1] = (values[inner - 1] if inner else 0) + 1
            out[k].append(values)
            if mark and special is not None:
                out[k].append(special(mark))

    def _add_special_id(self, mark: str) -> np.ndarray:
        return np.array([self.special[mark]], np.int64)

    def _encode_chunk(self, strings: list[str]) -> list[np.ndarray]:
        if not any(strings):
            return [np.zeros(0, np.int64)] * len(strings)
        s = Splits(strings)
        n, ids = self._gather(s.words(), self._ids, self._encode_words)
        upto = np.concatenate([[0], np.cumsum(n)])
        bounds = upto[np.searchsorted(s.word_at, s.ends)]
        return np.split(ids, bounds[:-1])

    def _count_chunk(self, strings: list[str]) -> list[np.ndarray]:
        if not any(strings):
            return [np.zeros(0, np.int64)] * len(strings)
        s = Splits(strings)
        n, within = self._gather(s.words(), self._counts, self._count_words)
        ends = np.cumsum(n)
        before = np.cumsum(within[ends - 1]) - within[ends - 1]
        piece_start = np.concatenate([[0], s.ends[:-1]])
        total = np.append(before, before[-1] + within[-1])
        base = total[np.searchsorted(s.word_at, piece_start)]
        word_of = np.repeat(np.arange(len(s.word_at)), np.diff(np.append(s.word_at, len(s.cp))))
        counts = before[word_of] + within[s.byte_at[1:] - 1]
        # A prefix that ends with a run of white space keeps the run in one word; the next
        # character would split its last one off.
        for a, b in s.runs:
            run = s.data[s.byte_at[a] : s.byte_at[b]]
            got = self._counts.get(run)
            if got is None:
                got = self._counts[run] = self.prefix_counts(run)
            counts[b - 1] = before[word_of[a]] + got[-1]
        # "'r" of "'re" is an apostrophe and a letter until the contraction is complete.
        if len(s.inner):
            counts[s.inner] = before[word_of[s.inner]] + 2
        return [c - b for c, b in zip(np.split(counts, s.ends[:-1]), base)]


def _running(parts: list[np.ndarray]) -> np.ndarray:
    """Prefix counts of a text's pieces, each shifted by what the earlier ones hold."""
    if len(parts) == 1:
        return parts[0]
    out, total = [], 0
    for p in parts:
        out.append(p + total)
        total += int(p[-1]) if len(p) else 0
    return np.concatenate(out) if out else np.zeros(0, np.int64)


@functools.lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    """The vocabulary of a worker process, read once."""
    return ByteBpe(path)
