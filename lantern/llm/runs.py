"""Periodic runs of words, by a harmonic grid with prefix hashes.

A run is a stretch of consecutive words with smallest period q - words q apart are equal - of
at least max(SHORTEST, 2 * q) words, that no neighbouring word extends keeping period q.

1. Words become 64-bit hashes, and prefix sums of them (times powers of an odd base) make the
   hash of any stretch one difference.
2. A stretch of 2 * q words holds two neighbouring points of the grid 0, q, 2 q, ... The grids
   of all periods are one list of pairs (m, q), q dividing m, ordered by m: a text of n words
   takes the list's first part, about n ln(n) pairs. Points m - q and m of a run hold one word,
   which most pairs fail.
3. For all pairs left at once, how far the stretches behind m - q and m agree (their longest
   common extension), and those before them, is found by binary search with the hashes. Where
   both reach q words together, and SHORTEST words in all, the pair's stretch is a run.
4. Runs found from several points, or with a multiple of their period, are one: the smallest
   period of each stretch is kept.
5. The words themselves of each run are then compared, and its neighbours. Where a hash has
   lied, that text's runs are found again with words' numbers in place of hashes, and the
   extensions by looking for the next unequal pair.

Memory follows the batch and the longest text of a task: 40 bytes a word, and PAIRS pairs at
a time. A text is never dealt out: runs lie in one text.

Defined results: null and empty texts, and texts of white space, have no words and no runs; a
run that is no shorter than max(SHORTEST, 2 q) counts wherever it lies, overlaps included;
repeated rows have equal results; a null doc_id is kept as it is; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lantern.llm.batches import map_rows
from lantern.llm.wordhash import BASE, SPACE, U, Words, powers
from lantern.session import table

#: Words that a run has at least.
SHORTEST = 12
#: Grid pairs that are looked at together.
PAIRS = 1 << 20
#: Words up to whose place the grid is kept between texts.
KEPT = 1 << 15

_grid: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None


def divisors(low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(m, q): every m from low to high - 1 (low at least 1) with each of its divisors."""
    q = np.arange(1, high)
    first = -(-low // q)
    count = (high - 1) // q - first + 1
    q, first = q[count > 0], first[count > 0]
    count = count[count > 0]
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    q = np.repeat(q, count)
    return (np.repeat(first, count) + step) * q, q


def grid(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (m, q) of a text of n words, q at most n / 2, in parts."""
    global _grid
    if _grid is None:
        m, q = divisors(1, KEPT)
        order = np.argsort(m, kind="stable")
        m, q = m[order].astype(np.int32), q[order].astype(np.int32)
        _grid = m, q, np.searchsorted(m, np.arange(KEPT + 1))
    m, q, at = _grid
    end = at[min(n, KEPT)]
    for i in range(0, end, PAIRS):
        use = q[i : min(i + PAIRS, end)] <= n // 2
        yield m[i : min(i + PAIRS, end)][use], q[i : min(i + PAIRS, end)][use]
    step = max(1, PAIRS // 16)
    for low in range(KEPT, n, step):
        a, b = divisors(low, min(low + step, n))
        use = b <= n // 2
        yield a[use], b[use]


class Extensions:
    """Longest common extensions in one text's words h (64-bit), by prefix hashes."""

    def __init__(self, h: np.ndarray):
        self.n = len(h)
        self.up = powers(BASE, self.n + 1)
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h * self.up[: self.n], dtype=np.uint64)])

    def same(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches of these lengths from i and from j (behind i) agree."""
        s = self.sums
        return (s[i + length] - s[i]) * self.up[j - i] == s[j + length] - s[j]

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self._longest(i, j, self.n - j, lambda i, j, k: self.same(i, j, k))

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree before i and before j."""
        return self._longest(i, j, i, lambda i, j, k: self.same(i - k, j - k, k))

    @staticmethod
    def _longest(i: np.ndarray, j: np.ndarray, most: np.ndarray, same: Callable) -> np.ndarray:
        low, high = np.zeros(len(i), dtype=np.int64), most.astype(np.int64)
        while len(at := np.nonzero(low < high)[0]):
            middle = (low[at] + high[at] + 1) >> 1
            yes = same(i[at], j[at], middle)
            low[at[yes]] = middle[yes]
            high[at[~yes]] = middle[~yes] - 1
        return low


def smallest_periods(start: np.ndarray, end: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct stretches with their smallest period, by start, then period."""
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    new = np.ones(len(q), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, q = start[new], end[new], q[new]
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def by_hash(h: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """start, end and period of the runs of words h; whether two stretches that start and end
    together have periods of which none divides the other (then a hash has lied)."""
    ext = Extensions(h)
    found, n = [], len(h)
    for m, q in grid(n):
        at = np.nonzero(h[m] == h[m - q])[0]
        m, q = m[at].astype(np.int64), q[at].astype(np.int64)
        # Half of the words that must agree do so behind the points, or more than the other
        # half before them.
        need = np.maximum(q, shortest - q)
        half, rest = (need + 1) // 2, need // 2 + 1
        fits, room = m + half <= n, m - q >= rest
        may = np.zeros(len(m), dtype=bool)
        may[fits] = ext.same((m - q)[fits], m[fits], half[fits])
        room &= ~may
        may[room] = ext.same((m - q - rest)[room], (m - rest)[room], rest[room])
        m, q, need = m[may], q[may], need[may]
        after, before = ext.forward(m - q, m), ext.backward(m - q, m)
        long = after + before >= need
        found.append((m[long] - q[long] - before[long], m[long] + after[long], q[long]))
    start, end, q = (np.concatenate(x) if found else np.zeros(0, dtype=np.int64) for x in (list(zip(*found)) or [[], [], []]))
    s, e, p = smallest_periods(start, end, q)
    lied = False
    if len(p) < len(q):
        key = np.lexsort((end, start))
        same = np.lexsort((e, s))
        own = np.repeat(p[same], np.diff(np.append(np.nonzero(np.append(True, (np.diff(start[key]) != 0) | (np.diff(end[key]) != 0)))[0], len(key))))
        lied = bool((q[key] % own != 0).any())
    return s, e, p, lied


def by_words(words: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As by_hash, for numbered words, exactly: extensions end at the next unequal pair."""
    n, found = len(words), []
    for m, q in grid(n):
        at = np.nonzero(words[m] == words[m - q])[0]
        for p in np.unique(q[at]).tolist():
            points = m[at][q[at] == p].astype(np.int64) - p
            unequal = np.nonzero(words[p:] != words[:-p])[0]
            edge = np.concatenate([[-1], unequal, [n - p]])
            k = np.searchsorted(edge, points)
            start, end = edge[k - 1] + 1, edge[k] + p
            long = end - start >= max(shortest, 2 * p)
            found.append((start[long], end[long], np.full(long.sum(), p)))
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 3
    return smallest_periods(*(np.concatenate(x) for x in zip(*found)))


class Text:
    """One text's words within a batch."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.data, self.start, self.end = data, start, end

    def __len__(self) -> int:
        return len(self.start)

    def words(self, a: int, b: int) -> list[bytes]:
        return self.data[self.start[a] : self.end[b - 1]].tobytes().split() if a < b else []

    def agree(self, a: int, b: int, q: int, part: int = 1 << 16) -> bool:
        """Whether words a to b - 1 have period q."""
        return all(self.words(i, min(i + part, b - q)) == self.words(i + q, min(i + part, b - q) + q) for i in range(a, b - q, part))

    def is_run(self, a: int, b: int, q: int) -> bool:
        unlike = lambda i: self.words(i, i + 1) != self.words(i + q, i + q + 1)
        return self.agree(a, b, q) and (a == 0 or unlike(a - 1)) and (b == len(self) or unlike(b - q))

    def numbered(self) -> np.ndarray:
        known: dict[bytes, int] = {}
        return np.array([known.setdefault(w, len(known)) for w in self.words(0, len(self))], dtype=np.int64)

    def joined(self, keep: np.ndarray, part: int = 1 << 16) -> Iterator[bytes]:
        """The kept words joined by a space, in parts."""
        first = True
        for i in range(0, len(self), part):
            k = keep[i : i + part]
            if not k.any():
                continue
            words = self.words(i, min(i + part, len(self)))
            if not k.all():
                words = [words[x] for x in np.nonzero(k)[0].tolist()]
            yield (b"" if first else b" ") + b" ".join(words)
            first = False


def runs(text: Text, h: np.ndarray, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end (exclusive) and smallest period of each run, by start, then period."""
    start, end, q, lied = by_hash(h, shortest)
    if lied or not all(text.is_run(a, b, p) for a, b, p in zip(start.tolist(), end.tolist(), q.tolist())):
        return by_words(text.numbered(), shortest)
    return start, end, q


def kept_words(n: int, start: np.ndarray, end: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which words stay if each run keeps its first period only."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, start + q, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1]) == 0


def texts_of(rows: dict, prepare: Callable[[object, bytes], bytes] | None) -> Iterator[tuple[object, Text, np.ndarray]]:
    """Id, words and word hashes of each row."""
    texts = [(t or "").encode("utf-8", "surrogatepass") for t in rows["text"]]
    if prepare:
        texts = [prepare(i, t) for i, t in zip(rows["doc_id"], texts)]
    w = Words(texts, SPACE)
    h = w.hashes()
    w.release()
    for i, a, b in zip(rows["doc_id"], w.first[:-1], w.first[1:]):
        yield i, Text(w.data, w.start[a:b], w.end[a:b]), h[a:b]


def find(docs: DataFrame, prepare: Callable[[object, bytes], bytes] | None = None, shortest: int = SHORTEST) -> DataFrame:
    """A row for each row of docs: doc_id, n_runs, the longest run (start, length, period,
    exponent_milli; ties: smallest start, then period), and digests of all runs and of the
    words that are left. prepare(doc_id, text) may change a text first."""
    def rows(b):
        for i, text, h in texts_of(b, prepare):
            start, end, q = runs(text, h, shortest)
            s, length, p = start.tolist(), (end - start).tolist(), q.tolist()
            best = min(range(len(s)), key=lambda x: (-length[x], s[x], p[x]), default=None)
            longest = (None,) * 4 if best is None else (s[best], length[best], p[best], 1000 * length[best] // p[best])
            every = hashlib.sha256("".join(f"{x},{y},{z}\n" for x, y, z in zip(s, length, p)).encode())
            left = hashlib.sha256()
            for part in text.joined(kept_words(len(text), start, end, q)):
                left.update(part)
            yield i, len(s), *longest, every.hexdigest(), left.hexdigest()

    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return map_rows(docs.select("doc_id", "text"), rows, schema)


def listed(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, start, length, period: a row for each run."""
    def rows(b):
        for i, text, h in texts_of(b, None):
            start, end, q = runs(text, h, shortest)
            yield from ((i, *x) for x in zip(start.tolist(), (end - start).tolist(), q.tolist()))

    return map_rows(docs.select("doc_id", "text"), rows, "doc_id long, start long, length long, period long")


def collapse(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, text: texts of which each run keeps its first period only, words joined by a
    space."""
    def rows(b):
        for i, text, h in texts_of(b, None):
            keep = kept_words(len(text), *runs(text, h, shortest))
            yield i, b"".join(text.joined(keep)).decode("utf-8", "surrogatepass")

    return map_rows(docs.select("doc_id", "text"), rows, "doc_id long, text string")


def planted(doc_id: int | None, text: bytes) -> bytes:
    """The text with a repetition in a tenth of the documents: with h the CRC-32 of the decimal
    doc_id and g = h // 10, where h % 10 is 0 each word i from a = g % n on becomes word
    a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8)."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10:
        return text
    w = Words([text], SPACE)
    n, g = len(w.start), h // 10
    if not n:
        return text
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    if a + p > n:
        return text
    whole, rest = divmod(n - a, p)
    unit = text[w.start[a] : w.end[a + p - 1]] + b" "
    part = text[w.start[a] : w.end[a + rest - 1]] if rest else b""
    return text[: w.start[a]] + unit * whole + part


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), prepare=planted)
