"""Removal of repeated passages by difference-cover suffix sorting.

A byte goes if a LENGTH-byte string that covers it also starts earlier (in a smaller doc_id,
or earlier in the same document), judged on the input. Suffixes are sorted only where a
repeat can be, and strings are dealt so that equal LENGTH-byte strings meet in one task:

1. The smallest hash of the GRAM-byte strings inside a LENGTH-byte window is a function of
   the window, so equal windows have equal keys. A run of successive windows with one key is
   a segment: its bytes are the windows' union. About 3 in 100 places begin one.
2. Segments whose key occurs once, in them too, hold no repeat. (A filter of
   fixed size keeps most of them from being dealt out.)
3. Segments equal in key and bytes: all but the earliest are removed. Minima and counts, so
   that thousands of copies are never in one task.
4. Different segments of one key: the difference-cover algorithm sorts their suffixes - it
   sorts the triples at places not divisible by 3, recurses on their names, orders the
   remaining suffixes by their first byte and the next rank, and merges both. Neighbours in
   the suffix array that agree in LENGTH bytes are one string; all but its earliest place are
   removed. Stretches whose windows have a hash of their own are left out before. Keys with more than CROWDED bytes of different segments, which one task shall
   not hold, are dealt anew, each window under its own 128-bit hash, and the earliest window
   of each found by minima.

The suffix array is built for each key's segments and not for the corpus as one string: a
full sort moves 20 bytes and more per suffix through several shuffles a level, many times
the input, where only few suffixes can matter.

Defined results: null and empty texts keep their zero bytes; texts under LENGTH bytes lose
nothing; rows equal in doc_id and text are one document; rows of one doc_id with different
texts are ordered by a hash of the text; null ids come last; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from lantern.llm.batches import map_columns, map_rows
from lantern.llm.wordhash import BASE, INVERSE, U, mixed, powers
from lantern.session import table, written

LENGTH = 100
GRAM = 32
#: Bits of the filters of keys and of segments: 32 MB each. A filter only saves work; one
#: too full for the input lets more pass, which later steps sort out.
FILTER_BITS = 28
#: Bytes of different segments of one key up to which a task sorts them.
CROWDED = 4 << 20
#: Bytes of segments that are sorted together.
SORTED = 1 << 20
#: Bytes of text that are hashed together: small enough for a core's cache.
PASS = 1 << 17
#: Removed ranges (8 bytes each, and 4 such a document) are broadcast up to so many, counted
#: first; beyond it texts are dealt out to them.
RANGES = 5_000_000


def sliding_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i : i + w] for each i."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    rows = np.concatenate([x, np.full(-len(x) % w, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, w)
    after = np.ascontiguousarray(np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1]).reshape(-1)
    before = np.minimum.accumulate(rows, axis=1).reshape(-1)
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


class Segments:
    """Segments of texts: doc (number of the text), key, first and last window (in bytes of
    the text), and a hash of the bytes."""

    def __init__(self, texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
        self.data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.begin = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        n = len(self.data)
        if n < length:
            self.doc = self.start = self.last = np.zeros(0, dtype=np.int64)
            self.key = self.hash = np.zeros(0, dtype=np.uint64)
            self.repeats = np.zeros(0, dtype=bool)
            return
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((self.data.astype(np.uint64) + U(1)) * powers(BASE, n), dtype=np.uint64)])
        down = powers(INVERSE, n + 1)
        grams = mixed((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
        least = sliding_minimum(grams, length - gram + 1)
        doc = np.repeat(np.arange(len(texts)), np.diff(self.begin))[: len(least)]
        inside = np.arange(len(least)) + length <= self.begin[doc + 1]
        edge = np.ones(len(least), dtype=bool)
        edge[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
        at = np.nonzero(edge & inside)[0]
        # A segment ends before the next edge, or with its text's last window.
        stop = np.append(np.nonzero(edge)[0], len(least))
        stop = stop[np.searchsorted(stop, at, side="right")] - 1
        self.doc, self.key = doc[at], least[at]
        self.start, self.last = at, np.minimum(stop, self.begin[self.doc + 1] - length)
        # A key that a window starts with, and that the next window has too, is there twice:
        # only then can two windows of the segment be equal.
        starts = np.concatenate([[0], np.cumsum(grams[: len(least)] == least)])
        self.repeats = starts[self.last] > starts[at]
        end = self.last + length
        self.hash = mixed((sums[end] - sums[at]) * down[at] ^ (end - at).astype(np.uint64))

    def bytes(self, i: int, length: int = LENGTH) -> bytes:
        return self.data[self.start[i] : self.last[i] + length].tobytes()


def joined(columns: list[np.ndarray]) -> np.ndarray | None:
    """One number a row, ordered as the columns (from 0, first most significant) are, where 62
    bits hold it."""
    bits = [int(c.max(initial=0)).bit_length() for c in columns]
    if sum(bits) > 62:
        return None
    out = columns[0]
    for c, n in zip(columns[1:], bits[1:]):
        out = (out << n) | c
    return out


def names(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows (columns, first most significant), and each row's name from 1 in it."""
    one = joined(columns)
    columns = columns if one is None else [one]
    order = np.lexsort(columns[::-1]) if one is None else np.argsort(one)
    new = np.zeros(len(order), dtype=bool)
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    name = np.empty(len(order), dtype=np.int64)
    name[order] = np.cumsum(new) + 1
    return order, name


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of s (values from 1) in order, by the difference cover {1, 2}
    modulo 3; a suffix that ends sorts before those that go on."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    t = np.concatenate([s, np.zeros(3, dtype=np.int64)]).astype(np.int64)
    # With a place past the end in class 1, class 1 ends in a triple of its own.
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    cover = np.concatenate([one, two])
    order, name = names([t[cover], t[cover + 1], t[cover + 2]])
    if name[order[-1]] < len(cover):
        order = suffix_array(name)
    rank = np.zeros(n + 3, dtype=np.int64)
    rank[cover[order]] = np.arange(1, len(cover) + 1)
    cover = cover[order]
    zero = np.arange(0, n, 3)
    first = joined([t[zero], rank[zero + 1]])
    zero = zero[np.lexsort((rank[zero + 1], t[zero])) if first is None else np.argsort(first)]
    # Each suffix of class 0 goes behind the smaller ones of class 1, and of class 2.
    wide = int(rank.max()) + 1
    j = cover[cover % 3 == 1]
    j = j[j < n]
    smaller = np.searchsorted(t[j] * wide + rank[j + 1], t[zero] * wide + rank[zero + 1])
    j = cover[cover % 3 == 2]
    top = int(t.max()) + 1
    pair = lambda i: (t[i] * top + t[i + 1]) * wide + rank[i + 2]
    if top * top * wide >= 1 << 62:  # names in place of pairs that would not fit
        _, both = names([np.concatenate([t[zero], t[j]]), np.concatenate([t[zero + 1], t[j + 1]])])
        smaller = smaller + np.searchsorted(both[len(zero) :] * wide + rank[j + 2], both[: len(zero)] * wide + rank[zero + 2])
    else:
        smaller = smaller + np.searchsorted(pair(j), pair(zero))
    cover = cover[cover < n]
    out = np.empty(n, dtype=np.int64)
    place = np.arange(len(zero)) + smaller
    out[place] = zero
    rest = np.ones(n, dtype=bool)
    rest[place] = False
    out[rest] = cover
    return out


def repeated(segments: list[bytes], order: list[tuple], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(segment, first window, last window) of the windows of segments that an earlier
    window equals; order: what a segment's windows are earlier by, its start last."""
    lengths = np.array([len(b) for b in segments])
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])
    s = np.frombuffer(b"\x00".join([*segments, b""]), dtype=np.uint8)
    text = np.where(np.isin(np.arange(len(s)), begin[1:] - 1), 0, s.astype(np.int64) + 1) + 1
    seg = np.repeat(np.arange(len(segments)), lengths + 1)
    offset = np.arange(len(s)) - begin[seg]
    sa = suffix_array(text)
    sa = sa[offset[sa] + length <= lengths[seg[sa]]]
    group = np.zeros(len(sa), dtype=np.int64)
    for i in range(1, len(sa), 65536):
        a, b = sa[i : i + 65536], sa[i - 1 : i - 1 + len(sa[i : i + 65536])]
        differs = np.zeros(len(a), dtype=bool)
        for j in range(0, length, 20):
            left = np.nonzero(~differs)[0]
            span = np.arange(j, min(j + 20, length))
            differs[left] = (text[a[left][:, None] + span] != text[b[left][:, None] + span]).any(axis=1)
        group[i : i + len(a)] = differs
    group = np.cumsum(group)
    ranks = {o: r for r, o in enumerate(sorted({o[:-1] for o in order}))}
    doc = np.array([ranks[o[:-1]] for o in order])
    first = np.array([o[-1] for o in order])
    by = np.lexsort((offset[sa] + first[seg[sa]], doc[seg[sa]], group))
    later = np.zeros(len(sa), dtype=bool)
    later[1:] = group[by][1:] == group[by][:-1]
    gone = np.sort(sa[by[later]])
    if not len(gone):
        return []
    cut = np.nonzero(np.append(True, (np.diff(gone) != 1) | (seg[gone][1:] != seg[gone][:-1])))[0]
    last = np.append(cut[1:], len(gone)) - 1
    return [(int(seg[gone[a]]), int(offset[gone[a]]), int(offset[gone[b]])) for a, b in zip(cut, last)]


def meeting(segments: list[bytes], length: int = LENGTH) -> list[tuple[int, int, bytes]]:
    """(segment, start, bytes): the stretches of segments whose windows all have a hash that
    another window has too. Equal windows have equal hashes, so all that can repeat is in them."""
    lengths = np.array([len(b) for b in segments])
    begin = np.concatenate([[0], np.cumsum(lengths)])
    data = np.frombuffer(b"".join(segments), dtype=np.uint8)
    if len(data) < length:
        return []
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((data.astype(np.uint64) + U(1)) * powers(BASE, len(data)), dtype=np.uint64)])
    hashes = mixed((sums[length:] - sums[:-length]) * powers(INVERSE, len(data) - length + 1))
    seg = np.repeat(np.arange(len(segments)), lengths)[: len(hashes)]
    inside = np.nonzero(np.arange(len(hashes)) + length <= begin[seg + 1])[0]
    order = np.argsort(hashes[inside])
    h = hashes[inside][order]
    same = np.zeros(len(h) + 1, dtype=bool)
    same[1:-1] = h[1:] == h[:-1]
    at = np.sort(inside[order[same[1:] | same[:-1]]])
    if not len(at):
        return []
    cut = np.nonzero(np.append(True, (np.diff(at) != 1) | (seg[at][1:] != seg[at][:-1])))[0]
    last = np.append(cut[1:], len(at)) - 1
    return [(int(seg[a]), int(a - begin[seg[a]]), data[a : b + length].tobytes()) for a, b in zip(at[cut], at[last])]


def own(docs: DataFrame) -> DataFrame:
    """d, k, text: a text's place in the order of documents."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("d"), F.xxhash64(text).alias("k"), text.alias("text"), "doc_id")


def utf8(b: dict) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in b["text"]]


def long(x: np.ndarray) -> list[int]:
    return x.view(np.int64).tolist()


def bitmap(positions: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """2**bits flags (65,536 at least) of column x, which is dealt out and packed by ranges of
    65,536: what reaches the driver is 32 MB for FILTER_BITS, whatever the input."""
    low = F.col("x").bitwiseAND(F.lit((1 << bits) - 1))
    p = positions.select(F.shiftright(low, 16).alias("range"), low.bitwiseAND(F.lit(65535)).cast("int").alias("bit")).distinct()
    lists = p.groupBy("range").agg(F.collect_list("bit").alias("bits"))

    def pack(b):
        out = []
        for bits in b["bits"]:
            flags = np.zeros(65536, dtype=np.uint8)
            flags[bits] = 1
            out.append(np.packbits(flags).tobytes())
        return [b["range"], out]

    whole = np.zeros(1 << bits - 3, dtype=np.uint8)
    got = map_columns(lists, pack, "range long, flags binary", text="bits").toArrow()
    for r, flags in zip(got.column("range").to_pylist(), got.column("flags").to_pylist()):
        whole[r << 13 : r + 1 << 13] = np.frombuffer(flags, dtype=np.uint8)
    return whole


def flagged(flags: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether the bit of each x is set; where some were put in, others may seem to be."""
    at = x & (8 * len(flags) - 1)
    return flags[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1


def columns(s: Segments, b: dict) -> tuple[np.ndarray, ...]:
    """Key, hash, document, text hash, first and last window of each segment."""
    begin = s.begin[s.doc]
    d, k = np.array(b["d"], dtype=np.int64), np.array(b["k"], dtype=np.int64)
    return s.key.view(np.int64), s.hash.view(np.int64), d[s.doc], k[s.doc], s.start - begin, s.last - begin


def removed(docs: DataFrame) -> DataFrame:
    """d, k, s, e: byte ranges to remove, which may overlap."""
    docs = own(docs)
    share = docs.sparkSession.sparkContext.broadcast

    def keys(b):
        s = Segments(utf8(b))
        return [np.concatenate([s.key, s.key[s.repeats]]).view(np.int64)]

    again = map_columns(docs.select("text"), keys, "m long", size=PASS).groupBy("m").count().filter("count > 1")
    held = share(bitmap(again.select(F.col("m").alias("x"))))

    def segments(b):
        s = Segments(utf8(b))
        m, *rest = columns(s, b)
        at = flagged(held.value, m)
        return [x[at] for x in (m, *rest, s.repeats)]

    rows = map_columns(docs.select("d", "k", "text"), segments, "m long, c long, d long, k long, p int, q int, r boolean", size=PASS)
    rows = written(rows, "segments")
    held.destroy()

    firsts = rows.groupBy("m", "c").agg(F.min(F.struct("d", "k", "p", "q")).alias("f"), F.count(F.lit(1)).alias("n"), F.max("r").alias("r"))
    firsts = written(firsts, "firsts")
    copies = rows.select("m", "c", "d", "k", "p", "q").join(firsts.filter("n > 1").select("m", "c", F.col("f.d").alias("fd"), F.col("f.k").alias("fk"), F.col("f.p").alias("fp")), ["m", "c"])
    copies = copies.filter((F.col("d") != F.col("fd")) | (F.col("k") != F.col("fk")) | (F.col("p") != F.col("fp")))
    out = copies.select("d", "k", F.col("p").alias("s"), (F.col("q") + LENGTH).alias("e"))

    kinds = firsts.groupBy("m").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("f.q") - F.col("f.p") + LENGTH).alias("size"), F.max("r").alias("r")).filter("kinds > 1 OR r").drop("kinds", "r")
    alike = written(firsts.select("m", "c", "f").join(kinds, "m").select("m", "c", "f.d", "f.k", "f.p", "size"), "alike")
    # The bytes of these alone are read, from the texts. A segment that the filter lets pass
    # by chance is one of the input's too, and changes nothing.
    one = F.col("c").bitwiseXOR(F.col("k")).bitwiseXOR(F.col("d")).bitwiseXOR(F.col("p").cast("long"))
    sorted_ = share(bitmap(alike.select(one.alias("x"))))

    def bytes_of(b):
        s = Segments(utf8(b))
        m, c, d, k, p, _ = columns(s, b)
        at = np.nonzero(flagged(sorted_.value, c ^ k ^ d ^ p))[0]
        return [m[at], d[at], k[at], p[at], [s.bytes(i) for i in at.tolist()]]

    strings = map_columns(docs.select("d", "k", "text"), bytes_of, "m long, d long, k long, p int, bytes binary", size=PASS)
    strings = written(strings, "strings")
    sorted_.destroy()
    crowded = alike.filter(F.col("size") > CROWDED).select("m").distinct()
    some = not crowded.isEmpty()
    lists = strings.join(crowded, "m", "left_anti") if some else strings
    lists = lists.groupBy("m").agg(F.collect_list(F.struct("d", "k", "p", "bytes")).alias("all"))

    def sort(b):
        batch: list[dict] = []
        size = 0
        for group in [*b["all"], None]:
            if group is None or (batch and size + sum(len(x["bytes"]) for x in group) > SORTED):
                if batch and (parts := meeting([x["bytes"] for x in batch])):
                    order = [(batch[i]["d"], batch[i]["k"], batch[i]["p"] + at) for i, at, _ in parts]
                    for i, s, e in repeated([x for _, _, x in parts], order):
                        d, k, p = order[i]
                        yield d, k, p + s, p + e + LENGTH
                batch, size = [], 0
            if group is not None:
                batch += group
                size += sum(len(x["bytes"]) for x in group)

    ranges = "d long, k long, s int, e int"
    out = out.unionByName(map_rows(lists, sort, ranges, text="all"))

    def windows(b):
        for d, k, p, x in zip(b["d"], b["k"], b["p"], b["bytes"]):
            for i in range(len(x) - LENGTH + 1):
                h = hashlib.blake2b(x[i : i + LENGTH], digest_size=16).digest()
                yield int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True), d, k, p + i

    if some:
        each = written(map_rows(strings.join(crowded, "m", "left_semi"), windows, "w1 long, w2 long, d long, k long, s int", text="bytes"), "windows")
        least = each.groupBy("w1", "w2").agg(F.min(F.struct("d", "k", "s")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        late = each.join(least, ["w1", "w2"]).filter(F.struct("d", "k", "s") != F.col("f"))
        out = out.unionByName(late.select("d", "k", "s", (F.col("s") + LENGTH).alias("e")))
    return out


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes): a row for each row of
    docs. Ranges are cut at byte places; what is left need not be valid UTF-8."""
    def merge(b):
        for d, k, gone in zip(b["d"], b["k"], b["gone"]):
            out = []
            for s, e in sorted((x["s"], x["e"]) for x in gone):
                if out and s <= out[-1]["e"]:
                    out[-1]["e"] = max(out[-1]["e"], e)
                else:
                    out.append({"s": s, "e": e})
            yield d, k, out

    ranges = removed(docs).groupBy("d", "k").agg(F.collect_list(F.struct("s", "e")).alias("gone"))
    ranges = written(map_rows(ranges, merge, "d long, k long, gone array<struct<s: int, e: int>>", text="gone"), "ranges")
    n = ranges.agg(F.sum(F.size("gone") + 4)).first()[0] or 0
    small = F.broadcast(ranges) if n <= RANGES else ranges

    def rows(b):
        for i, t, gone in zip(b["doc_id"], utf8(b), b["gone"]):
            gone, kept, at = gone or [], [], 0
            for x in gone:
                kept.append(t[at : x["s"]])
                at = x["e"]
            yield i, len(t), sum(x["e"] - x["s"] for x in gone), len(gone), b"".join([*kept, t[at:]])

    both = own(docs).join(small, ["d", "k"], "left").select("doc_id", "text", "gone")
    return map_rows(both, rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = deduplicate(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
