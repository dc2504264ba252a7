"""Words of UTF-8 texts and their hashes, for the operators that read whole texts in Python."""

from __future__ import annotations

import re
import zlib

import numpy as np

#: Digits, letters a to z and every byte of a character beyond ASCII, after lower-casing A to Z.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    """Words of a text in order; null has none."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class WordHashes(dict):
    """A row of hashes by word: its crc32 and those of its stems, 0 where the word is no longer than the stem.

    Kept for up to `most` words at once.
    """

    def __init__(self, stems: tuple[int, ...] = (), most: int = 300_000):
        super().__init__()
        self.stems, self.most = stems, most
        self.rows = np.zeros((4096, 1 + len(stems)), np.uint64)

    def __missing__(self, word: bytes) -> int:
        n = len(self)
        if n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        chars = word.decode("utf-8", "replace")
        self.rows[n] = [zlib.crc32(word), *(zlib.crc32(chars[:k].encode("utf-8", "replace"), k) if len(chars) > k else 0 for k in self.stems)]
        self[word] = n
        return n

    def of(self, tokens: list[bytes]) -> np.ndarray:
        """One row per token."""
        if len(self) > self.most:
            self.clear()
        at = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        return self.rows[at]
