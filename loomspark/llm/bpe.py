"""Exact byte-pair encoding by last-token states.

A sequence of tokens is the encoding of its bytes if and only if each of its tokens is its own encoding and each two
neighbours are compatible: their joined bytes encode to just these two. Every prefix of a word hence has one last token:
the only token ending there that is compatible with the last token of the prefix before it. Two operators build on it:

* :class:`Counter` runs a word through an automaton of the whole vocabulary and keeps a number per position: tokens are
  counted in linear time and never listed;
* :class:`Encoder` walks the trie of a batch's distinct words depth first (words in order, each continuing from the prefix
  it shares with the one before), so states of shared prefixes are computed once.

The vocabulary is a public file of ranks; it is read from a path, never copied.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable

import ahocorasick
import numpy as np
import regex

#: Used where no other file is named.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokeniser's pattern of this vocabulary. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_MEMO = 2_000_000


class Vocabulary:
    def __init__(self, path: str = VOCABULARY):
        self.rank: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                token, _, rank = line.partition(b" ")
                self.rank[base64.b64decode(token)] = int(rank)
        self.bytes = {r: t for t, r in self.rank.items()}
        self.suffixes = {t[i:] for t in self.rank for i in range(len(t))}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}

    def merge(self, word: bytes) -> list[bytes]:
        """Plain merging, for the short strings of two tokens."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get(parts[i] + parts[i + 1], 1 << 30))
            if parts[best] + parts[best + 1] not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def whole(self, token: int) -> bool:
        ok = self._whole.get(token)
        if ok is None:
            ok = self._whole[token] = self.merge(self.bytes[token]) == [self.bytes[token]]
        return ok

    def compatible(self, a: int, b: int) -> bool:
        ok = self._pairs.get((a, b))
        if ok is None:
            if len(self._pairs) > _MEMO:
                self._pairs.clear()
            x, y = self.bytes[a], self.bytes[b]
            ok = self._pairs[a, b] = self.merge(x + y) == [x, y]
        return ok


class Counter:
    """Tokens of a text, counted."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = PATTERN, remembered: int = 1_000_000):
        self.v = vocabulary
        self.split = regex.compile(pattern).findall
        self.remembered = remembered
        self.automaton = ahocorasick.Automaton()
        for token, rank in vocabulary.rank.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        data = word.encode()
        if data in self.v.rank and self.v.whole(self.v.rank[data]):
            return 1
        n = len(data)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        compatible, whole = self.v.compatible, self.v.whole
        for end, (token, length) in self.automaton.iter(data.decode("latin-1")):
            i = end + 1
            if last[i] < 0:
                start = i - length
                if (whole(token) if start == 0 else last[start] >= 0 and compatible(last[start], token)):
                    last[i], count[i] = token, count[start] + 1
        return count[n]

    def text(self, text: str) -> int:
        known, total = self.known, 0
        for w in self.split(text):
            n = known.get(w)
            if n is None:
                if len(known) > self.remembered:
                    known.clear()
                n = known[w] = self.word(w)
            total += n
        return total


class Encoder:
    """Token ids of texts; the distinct new words of a batch share the states of their common prefixes."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = PATTERN, remembered: int = 1_000_000, characters: int = 4_000_000):
        self.v = vocabulary
        self.split = regex.compile(pattern).findall
        self.remembered, self.characters = remembered, characters
        self.known: dict[str, bytes] = {}

    def learn(self, words: Iterable[str]) -> None:
        """Depth-first over the trie of the words not known yet: ``last`` and ``start`` are the path's states."""
        rank, suffixes, compatible, whole = self.v.rank, self.v.suffixes, self.v.compatible, self.v.whole
        path, last, start = b"", [-1], [0]
        for data, word in sorted((w.encode(), w) for w in words if w not in self.known):
            shared = 0
            for x, y in zip(path, data):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], start[shared + 1 :]
            for i in range(shared + 1, len(data) + 1):
                token, begin = -1, i
                ends = []
                j = i - 1
                while j >= 0 and data[j:i] in suffixes:
                    r = rank.get(data[j:i])
                    if r is not None:
                        ends.append((r, j))
                    j -= 1
                for r, j in reversed(ends):
                    if (whole(r) if j == 0 else compatible(last[j], r)):
                        token, begin = r, j
                        break
                last.append(token), start.append(begin)
            ids, i = [], len(data)
            while i:
                ids.append(last[i])
                i = start[i]
            self.known[word] = np.array(ids[::-1], np.int32).tobytes()
            path = data

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the offsets of each; null and empty texts have none.

        The new words of many texts are one trie. Texts are taken together up to ``characters``, which bounds the memory.
        """
        parts, sizes, held, size = [], [], [], 0

        def flush() -> None:
            nonlocal held, size
            if len(self.known) > self.remembered:
                self.known.clear()
            self.learn({w for words in held for w in words}.difference(self.known))
            for words in held:
                data = b"".join(map(self.known.__getitem__, words))
                parts.append(data)
                sizes.append(len(data) // 4)
            held, size = [], 0

        for text in texts:
            held.append(self.split(text) if text else [])
            size += len(text or "")
            if size > self.characters:
                flush()
        flush()
        return np.frombuffer(b"".join(parts), np.int32), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
