"""Words of many texts at once: byte positions and 64-bit hashes as arrays."""

from __future__ import annotations

import numpy as np

# A multiplier of the polynomial hash and its inverse modulo 2**64; constants of the mixer.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
U = np.uint64

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    if len(_powers.get(base, ())) < n:
        p = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        p[0] = 1
        _powers[base] = np.multiply.accumulate(p)
    return _powers[base][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * MIX[0]
    x = (x ^ (x >> U(27))) * MIX[1]
    return x ^ (x >> U(31))


class Words:
    """Words of texts, separated by the bytes that `separates` marks (256 flags).

    data: all texts, each followed by a space; start, end: each word's bytes in data;
    doc: its text's number; first: number of each text's first word, and the count of all."""

    def __init__(self, texts: list[bytes], separates: np.ndarray):
        self.data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
        word = ~separates[self.data]
        edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
        self.start, self.end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        self.begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)])
        self.first = np.searchsorted(self.start, self.begin)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self._sums: np.ndarray | None = None

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of data[start:end]."""
        if self._sums is None:
            n = len(self.data)
            self._sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((self.data.astype(np.uint64) + U(1)) * powers(BASE, n), dtype=np.uint64)])
        x = (self._sums[end] - self._sums[start]) * powers(INVERSE, len(self.data) + 1)[start]
        return mixed(x ^ (end - start).astype(np.uint64) << U(56))

    def release(self) -> None:
        """Frees the sums that hash() keeps."""
        self._sums = None

    def hashes(self) -> np.ndarray:
        return self.hash(self.start, self.end)


#: Bytes between words: white space, and what is not a letter, digit or non-ASCII byte.
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
MARKS = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def lowered(text: str | None) -> bytes:
    """UTF-8 of the text with A to Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER)
