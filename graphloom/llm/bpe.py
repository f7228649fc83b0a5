"""Byte-level BPE by a contiguous rank array.

A word's parts lie side by side in one array, and beside it lies the array of the ranks of adjacent pairs. The least rank is
looked for, its boundary deleted, and the ranks to its left and right are refreshed, until no pair has a rank. New words of equal length are
merged together, as rows of one matrix, so a scan for the minimum is one vector operation; words longer than LONG_WORD
bytes use a heap over the same ranks. Each worker keeps the ids of words it has met.
"""

from __future__ import annotations

import base64
import heapq
import os
from functools import lru_cache

import numpy as np

#: Where the public vocabularies lie; the environment variable or a parameter overrides it.
TOKENIZER_DIR = os.environ.get("GRAPHLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that splits text into words before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_WORD = 400
#: Words a worker remembers (some 60 MB) before it starts anew.
REMEMBERED = 250_000
_NONE = np.int32(2**31 - 1)


class Vocabulary:
    """Ranks of byte strings, and the rank of every pair of parts that some merge could join."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        left, right, out = [], [], []
        get = self.ranks.get
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a = get(token[:i])
                if a is not None and (b := get(token[i:])) is not None:
                    left.append(a)
                    right.append(b)
                    out.append(rank)
        self.width = max(self.tokens) + 1
        keys = np.array(left, dtype=np.int64) * self.width + np.array(right, dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.joined = keys[order], np.array(out, dtype=np.int32)[order]

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank, and id, of each pair joined; _NONE where it is no token."""
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.joined[at], _NONE)

    def merge_rows(self, words: np.ndarray) -> list[list[int]]:
        """Token ids of words of one length, given as rows of bytes."""
        n, size = words.shape
        parts = self.single[words]
        if size == 1:
            return parts.tolist()
        ranks = np.full((n, size), _NONE, dtype=np.int32)
        ranks[:, :-1] = self.pair_ranks(parts[:, :-1], parts[:, 1:])
        length = np.full(n, size)
        rows = np.arange(n)
        done: list = [None] * n
        at_all = np.arange(size)
        while len(rows):
            best = ranks.argmin(1)
            i = np.arange(len(rows))
            least = ranks[i, best]
            over = least == _NONE
            if over.any():
                for r, x, m in zip(rows[over], parts[over], length[over]):
                    done[r] = x[:m].tolist()
                keep = ~over
                rows, parts, ranks, length, best, least = rows[keep], parts[keep], ranks[keep], length[keep], best[keep], least[keep]
                i = np.arange(len(rows))
                if not len(rows):
                    break
            parts[i, best] = least
            # Delete the boundary after `best`: all to its right move one place to the left.
            source = np.minimum(at_all[None, :] + (at_all[None, :] > best[:, None]), size - 1)
            parts, ranks = np.take_along_axis(parts, source, 1), np.take_along_axis(ranks, source, 1)
            length = length - 1
            ranks[:, size - 1] = _NONE
            right = np.minimum(best + 1, size - 1)
            fresh = self.pair_ranks(parts[i, best], parts[i, right])
            ranks[i, best] = np.where(best + 1 < length, fresh, _NONE)
            before = np.maximum(best - 1, 0)
            fresh = self.pair_ranks(parts[i, before], parts[i, best])
            ranks[i, before] = np.where(best > 0, fresh, ranks[i, before])
            most = int(length.max())
            if most + 8 < size:  # the matrix narrows as words shrink
                size = most + 1
                parts, ranks, at_all = parts[:, :size].copy(), ranks[:, :size].copy(), np.arange(size)
        return done

    def merge_long(self, word: bytes) -> list[int]:
        """Token ids of one very long word, in n log n steps."""
        parts = self.single[np.frombuffer(word, np.uint8)].tolist()
        n = len(parts)
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        first = self.pair_ranks(np.array(parts[:-1]), np.array(parts[1:]))
        table = self._table()
        heap = [(int(r), i, parts[i], parts[i + 1]) for i, r in enumerate(first) if r != _NONE]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], nxt[i] = rank, False, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if (r := table.get(rank * self.width + parts[nxt[i]])) is not None:
                    heapq.heappush(heap, (r, i, rank, parts[nxt[i]]))
            if prv[i] >= 0 and (r := table.get(parts[prv[i]] * self.width + rank)) is not None:
                heapq.heappush(heap, (r, prv[i], parts[prv[i]], rank))
        return [parts[i] for i in range(n) if alive[i]]

    @lru_cache(maxsize=1)  # noqa: B019
    def _table(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.joined.tolist()))


class Encoder:
    """Encodes texts, remembering words."""

    def __init__(self, path: str):
        import regex

        self.vocabulary = Vocabulary(path)
        self.words = regex.compile(PATTERN)
        self.known: dict[str, tuple[int, ...]] = {}

    def learn(self, texts: list[list[str]]) -> dict[str, tuple[int, ...]]:
        """The known words after all words of the texts, given as words, have been merged."""
        new = {w for words in texts for w in words if w not in self.known}
        if new and len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = {w for words in texts for w in words}
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for w in new:
            b = w.encode("utf-8", "replace")
            if len(b) > LONG_WORD:
                self.known[w] = tuple(self.vocabulary.merge_long(b))
            elif (whole := self.vocabulary.ranks.get(b)) is not None:
                self.known[w] = (whole,)
            else:
                by_size.setdefault(len(b), []).append((w, b))
        for size, group in by_size.items():
            step = max(1, 400_000 // size)
            for i in range(0, len(group), step):
                part = group[i : i + step]
                rows = np.frombuffer(b"".join(b for _, b in part), np.uint8).reshape(len(part), size)
                for (w, _), ids in zip(part, self.vocabulary.merge_rows(rows)):
                    self.known[w] = tuple(ids)
        return self.known

    def split(self, text: str) -> list[str]:
        return self.words.findall(text)

    def encode_words(self, texts: list[list[str]]) -> list[list[int]]:
        """Token ids of texts given as words."""
        known = self.learn(texts)
        return [[i for w in words for i in known[w]] for words in texts]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Token ids of texts; an empty or null text has none."""
        return self.encode_words([self.split(t) if t else [] for t in texts])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of this process."""
    return Encoder(path)


def vocabulary_path(directory: str | None = None, name: str = VOCABULARY) -> str:
    return os.path.join(directory or TOKENIZER_DIR, name)
