"""Media columns: byte payloads as FLAC streams, written, checked and read back.

encode() stores a payload as one-channel 8-bit FLAC (a byte b is the sample b - 128): fixed
blocks of 192 samples, each a constant, verbatim, or Rice-coded residual of a fixed linear
predictor of order 0 to 2 or of one of order 4 fitted to the block (whole-number
autocorrelations, Levinson's recursion, coefficients of 12 bits), whichever is smallest;
STREAMINFO holds the samples' MD5, and a seek table points at every SEEK-th frame. decode()
reads constant, verbatim, fixed (order 0 to 4) and LPC subframes with partitioned Rice
residuals of either method, verifies each header's CRC-8, each frame's CRC-16 and the MD5, and
raises FlacError where one fails. blocks() cuts what was read into PCM blocks by sample offset,
and read_at() reads some samples only, from the seek point before them.

Frames are independent, so all frames of a group of rows are worked on at once: step i
handles sample i of every frame. A frame's start is found by its sync code, header checksum
and number; that each frame ends where the next begins is checked after decoding.

Defined results: null and empty texts are one block of spaces; each row stands for itself
and equal texts give equal values; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lantern.llm.batches import map_rows
from lantern.session import table

BLOCK = 192
SEEK = 512  # frames between seek points
RATE = 8000
GROUP = 8192  # frames worked on at once
ORDER, PRECISION, SHIFT = 4, 12, 9  # of fitted predictors


class FlacError(ValueError):
    """A stream that is cut short, malformed or fails a checksum."""


def crc_table(poly: int, bits: int) -> np.ndarray:
    t = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        t = np.where(t >> (bits - 1) & 1, (t << 1) ^ poly, t << 1) & ((1 << bits) - 1)
    return t.astype(np.uint16)


CRC8, CRC16 = crc_table(0x07, 8), crc_table(0x8005, 16)
ZEROS16 = np.array([16 - int(x).bit_length() for x in range(1 << 16)], dtype=np.int64)


def crc16(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-16 of data[start : start + length] for each start: longest first, so that the
    frames still running are a prefix."""
    order = np.argsort(-length, kind="stable")
    s, n = start[order], length[order]
    crc = np.zeros(len(s), dtype=np.uint16)
    running = len(s)
    for j in range(int(n[0]) if len(n) else 0):
        while n[running - 1] <= j:
            running -= 1
        c = crc[:running]
        crc[:running] = (c << 8) ^ CRC16[(c >> 8) ^ data[s[:running] + j]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def crc8(header: np.ndarray) -> np.ndarray:
    """CRC-8 of each row."""
    crc = np.zeros(len(header), dtype=np.uint16)
    for j in range(header.shape[1]):
        crc = CRC8[crc ^ header[:, j]]
    return crc.astype(np.uint8)


def coded_number(n: int) -> bytes:
    """A frame number in FLAC's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    tail = []
    while n >= 1 << (6 - len(tail)):  # the first byte has room for 6 - len(tail) bits
        tail.insert(0, 0x80 | n & 0x3F)
        n >>= 6
    return bytes([0xFF00 >> (len(tail) + 1) & 0xFF | n, *tail])


def rice(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits, parameter) of each row of u, folded residuals, coded with the best parameter near
    the one their mean suggests."""
    guess = np.log2(np.maximum(u.mean(axis=1), 1e-9) * 0.7).round().clip(0, 8).astype(np.int64)
    bits, k = np.full(len(u), 1 << 40), np.zeros(len(u), dtype=np.int64)
    for d in (-1, 0, 1):
        kk = np.clip(guess + d, 0, 14)
        n = (u >> kk[:, None].astype(np.uint16)).sum(axis=1, dtype=np.int64) + u.shape[1] * (kk + 1)
        better = n < bits
        k[better], bits[better] = kk[better], n[better]
    return bits, k


def fitted(samples: np.ndarray) -> np.ndarray:
    """Coefficients (F, ORDER), in units of 2**-SHIFT, of each block's linear predictor. Sums are
    of whole numbers and all else is row by row, so equal blocks have equal coefficients."""
    x = samples.astype(np.int64)
    r = np.stack([(x[:, lag:] * x[:, : BLOCK - lag]).sum(axis=1) for lag in range(ORDER + 1)], axis=1).astype(np.float64)
    a, left = np.zeros((len(x), ORDER)), np.maximum(r[:, 0], 1e-9)
    for m in range(ORDER):
        miss = r[:, m + 1].copy()
        for j in range(m):
            miss -= a[:, j] * r[:, m - j]
        turn = np.where(left > 1e-6, miss / left, 0)
        new = a.copy()
        for j in range(m):
            new[:, j] = a[:, j] - turn * a[:, m - 1 - j]
        new[:, m] = turn
        a, left = new, np.maximum(left * (1 - turn * turn), 1e-9)
    most = (1 << PRECISION - 1) - 1
    return np.clip(np.rint(a * (1 << SHIFT)), -most, most).astype(np.int64)


def folded(e: np.ndarray) -> np.ndarray:
    return ((e << 1) ^ (e >> 15)).astype(np.uint16)


def frames(samples: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of samples (F, 192) int16: their bytes one after the other, and each length."""
    f = len(samples)
    u_by, cost = {}, []
    for order in range(3):
        u_by[8 + order] = folded(np.diff(samples, order, axis=1) if order else samples)
        cost.append(u_by[8 + order].sum(axis=1, dtype=np.int64) + order * 8)
    best = np.argmin(np.stack(cost), axis=0)
    kind, k, bits = np.full(f, 1), np.zeros(f, dtype=np.int64), np.full(f, BLOCK * 8 + 8)

    def offer(code: int, at: np.ndarray, extra: int) -> None:
        n, kk = rice(u_by[code][at])
        n += extra
        better = n < bits[at]
        kind[at[better]], k[at[better]], bits[at[better]] = code, kk[better], n[better]

    for order in range(3):
        at = np.nonzero(best == order)[0]
        if len(at):
            offer(8 + order, at, 18 + order * 8)
    linear = fitted(samples)
    guess = sum(linear[:, j : j + 1] * samples[:, ORDER - 1 - j : BLOCK - 1 - j] for j in range(ORDER)) >> SHIFT
    code = 31 + ORDER
    u_by[code] = folded((samples[:, ORDER:] - guess).astype(np.int16))
    lead = 9 + ORDER * PRECISION
    offer(code, np.arange(f), 18 + ORDER * 8 + lead)
    same = (samples == samples[:, :1]).all(axis=1)
    kind[same], bits[same] = 0, 16
    codes = [coded_number(int(n)) for n in numbers]
    n_code = np.array([len(c) for c in codes])
    length = 4 + n_code + 1 + (bits + 7) // 8 + 2
    start = np.concatenate([[0], np.cumsum(length)])
    out = np.zeros(int(start[-1]), dtype=np.uint8)
    for c in np.unique(n_code):
        at = np.nonzero(n_code == c)[0]
        head = np.empty((len(at), 4 + c), dtype=np.uint8)
        head[:, :4] = (0xFF, 0xF8, 0x10, 0x02)
        head[:, 4:] = np.frombuffer(b"".join(codes[i] for i in at), dtype=np.uint8).reshape(-1, c)
        out[start[at][:, None] + np.arange(4 + c)] = head
        out[start[at] + 4 + c] = crc8(head)
    body = start[:-1] + 5 + n_code
    out[body] = kind << 1
    at = np.nonzero(kind == 0)[0]
    out[body[at] + 1] = samples[at, 0].astype(np.int8).view(np.uint8)
    at = np.nonzero(kind == 1)[0]
    out[body[at][:, None] + 1 + np.arange(BLOCK)] = samples[at].astype(np.int8).view(np.uint8)
    for code, u_all in u_by.items():
        order, lead = (ORDER, 9 + ORDER * PRECISION) if code >= 32 else (code - 8, 0)
        for kk in np.unique(k[kind == code]):
            at = np.nonzero((kind == code) & (k == kk))[0]
            out[body[at][:, None] + 1 + np.arange(order)] = samples[at, :order].astype(np.int8).view(np.uint8)
            u = u_all[at].astype(np.int64)
            q = u >> kk
            ends = np.cumsum(q + kk + 1, axis=1)  # in bits, each code's end
            width = (lead + 10 + int(ends[:, -1].max()) + 7) // 8 * 8
            row = np.zeros((len(at), width), dtype=np.uint8)
            if lead:
                fields = [(PRECISION - 1, 4), (SHIFT, 5)] + [(linear[at, j], PRECISION) for j in range(ORDER)]
                place = 0
                for value, n in fields:
                    for j in range(n):
                        row[:, place + j] = (value >> (n - 1 - j)) & 1
                    place += n
            row[:, lead + 6 : lead + 10] = (kk >> np.array([3, 2, 1, 0])) & 1
            flat, place = row.reshape(-1), (np.arange(len(at)) * width + lead + 10)[:, None] + ends
            flat[place - kk - 1] = 1
            for j in range(kk):
                flat[place - 1 - j] = (u >> j) & 1
            packed = np.packbits(row, axis=1)
            n = (lead + 10 + ends[:, -1] + 7) // 8
            mask = np.arange(packed.shape[1]) < n[:, None]
            out[((body[at] + 1 + order)[:, None] + np.arange(packed.shape[1]))[mask]] = packed[mask]
    crc = crc16(out, start[:-1], length - 2)
    out[start[1:] - 2], out[start[1:] - 1] = crc >> 8, crc & 0xFF
    return out, length


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload (a positive multiple of 192 bytes)."""
    n_frames = [len(p) // BLOCK for p in payloads]
    numbers = np.concatenate([np.arange(n) for n in n_frames])
    samples = np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, BLOCK)
    parts = [frames(samples[i : i + GROUP].astype(np.int16) - 128, numbers[i : i + GROUP]) for i in range(0, len(samples), GROUP)]
    data, length = np.concatenate([p for p, _ in parts]), np.concatenate([n for _, n in parts])
    start = np.concatenate([[0], np.cumsum(length)])
    out, at = [], 0
    for p, n in zip(payloads, n_frames):
        own, offset = length[at : at + n], start[at : at + n]
        md5 = hashlib.md5((np.frombuffer(p, dtype=np.uint8) ^ 0x80).tobytes()).digest()
        info = struct.pack(">HH", BLOCK, BLOCK) + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + md5
        seek = b"".join(struct.pack(">QQH", i * BLOCK, int(offset[i] - offset[0]), BLOCK) for i in range(0, n, SEEK))
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + data[start[at] : start[at + n]].tobytes())
        at += n
    return out


class Bits:
    """Fields of up to 25 bits read at many bit positions of one buffer at once."""

    def __init__(self, data: np.ndarray):
        d = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(np.uint32)
        self.words = d[:-3] << 24 | d[1:-2] << 16 | d[2:-1] << 8 | d[3:]

    def window(self, at: np.ndarray) -> np.ndarray:
        return self.words[np.minimum(at >> 3, len(self.words) - 1)] << (at & 7).astype(np.uint32)

    def unsigned(self, at: np.ndarray, n) -> np.ndarray:
        n = np.broadcast_to(np.asarray(n, dtype=np.uint32), at.shape)
        return np.where(n == 0, 0, self.window(at) >> np.where(n == 0, 0, 32 - n)).astype(np.int64)

    def signed(self, at: np.ndarray, n) -> np.ndarray:
        x = self.unsigned(at, n)
        n = np.broadcast_to(np.asarray(n, dtype=np.int64), at.shape)
        return np.where((n > 0) & (x >> np.maximum(n - 1, 0) & 1 == 1), x - (np.int64(1) << n), x)

    def zeros(self, at: np.ndarray) -> np.ndarray:
        """Zero bits before the next one bit."""
        n = ZEROS16[self.window(at) >> 16]
        more = np.nonzero(n == 16)[0]
        while len(more):
            if int((at[more] + n[more]).max()) >> 3 >= len(self.words):
                raise FlacError("a unary code runs past the end")
            z = ZEROS16[self.window(at[more] + n[more]) >> 16]
            n[more] += z
            more = more[z == 16]
        return n


def residual(bits: Bits, pos: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Partitioned Rice residuals from pos on, for frames of one predictor order."""
    f = len(pos)
    method, parts = bits.unsigned(pos, 2), bits.unsigned(pos + 2, 4)
    if (method > 1).any() or ((BLOCK >> parts) << parts != BLOCK).any():
        raise FlacError("unknown residual coding")
    pos, width = pos + 6, 4 + method
    e = np.zeros((f, BLOCK), dtype=np.int64)
    size, k, raw = BLOCK >> parts, np.zeros(f, dtype=np.int64), np.zeros(f, dtype=np.int64)
    for i in range(order, BLOCK):
        new = (i % size == 0) | (i == order)
        if new.any():
            at = np.nonzero(new)[0]
            k[at] = bits.unsigned(pos[at], width[at])
            pos[at] += width[at]
            escape = at[k[at] == (1 << width[at]) - 1]
            raw[at] = -1
            raw[escape] = bits.unsigned(pos[escape], 5)
            pos[escape] += 5
        if (raw >= 0).any():
            at, rice = np.nonzero(raw >= 0)[0], np.nonzero(raw < 0)[0]
            e[at, i] = bits.signed(pos[at], raw[at])
            pos[at] += raw[at]
            q = bits.zeros(pos[rice])
            pos[rice] += q + 1
            u = q << k[rice] | bits.unsigned(pos[rice], k[rice])
            e[rice, i] = u >> 1 ^ -(u & 1)
            pos[rice] += k[rice]
        else:
            q = bits.zeros(pos)
            pos += q + 1
            u = q << k | bits.unsigned(pos, k)
            e[:, i] = u >> 1 ^ -(u & 1)
            pos += k
    return e, pos


FIXED = ([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])


def subframes(data: np.ndarray, bits: Bits, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples (F, 192) of the frames whose subframe starts at byte body, and their ends."""
    out, end = np.zeros((len(body), BLOCK), dtype=np.int64), np.zeros(len(body), dtype=np.int64)
    head = data[np.minimum(body, len(data) - 1)]
    if (head & 0x81).any():
        raise FlacError("wasted bits or a reserved bit")
    for kind in np.unique(head >> 1).tolist():
        at = np.nonzero(head >> 1 == kind)[0]
        pos = body[at] * 8 + 8
        order = kind & 7 if 8 <= kind <= 12 else kind - 31 if kind >= 32 else -1
        if kind == 0:
            out[at], pos = bits.signed(pos, 8)[:, None], pos + 8
        elif kind == 1:
            out[at], pos = bits.signed(pos[:, None] + np.arange(BLOCK) * 8, 8), pos + BLOCK * 8
        elif order >= 0:
            warm = bits.signed(pos[:, None] + np.arange(order) * 8, 8)
            pos = pos + order * 8
            if kind >= 32:
                precision = bits.unsigned(pos, 4) + 1
                if (precision == 16).any():
                    raise FlacError("reserved coefficient precision")
                shift = bits.signed(pos + 4, 5)
                coefficients = bits.signed((pos + 9)[:, None] + np.arange(order) * precision[:, None], precision[:, None])
                pos = pos + 9 + order * precision
            else:
                shift, coefficients = np.zeros(len(at), dtype=np.int64), np.broadcast_to(np.array(FIXED[order], dtype=np.int64), (len(at), order))
            e, pos = residual(bits, pos, order)
            if kind == 8:
                x = e
            elif kind == 9:
                e[:, :1] = warm
                x = np.cumsum(e, axis=1)
            else:
                x = e
                x[:, :order] = warm
                for i in range(order, BLOCK):
                    x[:, i] += (coefficients * x[:, i - order : i][:, ::-1]).sum(axis=1) >> shift
            out[at] = x
        else:
            raise FlacError("reserved subframe type")
        end[at] = (pos + 7) // 8
    return out, end


def header(stream: bytes) -> tuple[int, int, bytes]:
    """First frame's byte, samples and MD5 of a stream that decode() can read."""
    if stream[:4] != b"fLaC" or len(stream) < 42:
        raise FlacError("not a FLAC stream")
    at, info, last = 4, b"", False
    while not last:
        if at + 4 > len(stream):
            raise FlacError("metadata runs past the end")
        last, kind, n = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        if kind == 0:
            info = stream[at + 4 : at + 4 + n]
        at += 4 + n
    packed = int.from_bytes(info[10:18], "big")
    if info[:4] != struct.pack(">HH", BLOCK, BLOCK) or packed >> 41 & 7 or packed >> 36 & 31 != 7:
        raise FlacError("only one channel of 8-bit samples in blocks of 192 is read")
    return at, packed & (1 << 36) - 1, info[18:34]


def scan(s: bytes, at: int, numbers: range) -> tuple[list[int], list[int]]:
    """(starts, bodies) of the frames of these numbers, the first at byte `at` or after it."""
    starts, bodies = [], []
    for number in numbers:
        mark = b"\xff\xf8\x10\x02" + coded_number(number)
        c = 0
        for x in mark:
            c = int(CRC8[c ^ x])
        while True:
            at = s.find(mark, at)
            if at < 0 or at + len(mark) >= len(s):
                raise FlacError("a frame is missing")
            if s[at + len(mark)] == c:
                break
            at += 1
        starts.append(at)
        bodies.append(at + len(mark) + 1)
        at += len(mark)
    return starts, bodies


def bytes_of(data: np.ndarray, start: np.ndarray, body: np.ndarray, stop: np.ndarray) -> bytes:
    """The payload bytes of frames, checksums verified; GROUP frames at a time."""
    parts = []
    for i in range(0, len(start), GROUP):
        j = min(i + GROUP, len(start))
        lo, hi = start[i], stop[j - 1]
        part = data[lo:hi]
        x, end = subframes(part, Bits(part), body[i:j] - lo)
        if (end + 2 != stop[i:j] - lo).any():
            raise FlacError("a frame doesn't end where the next begins")
        if (crc16(part, start[i:j] - lo, stop[i:j] - start[i:j]) != 0).any():
            raise FlacError("frame checksum")
        parts.append((x + 128).astype(np.uint8).tobytes())
    return b"".join(parts)


def decode(streams: list[bytes]) -> list[bytes]:
    """The payload of each stream, all checksums verified."""
    starts, bodies, stops, counts, heads = [], [], [], [], []
    data = np.frombuffer(b"".join(streams), dtype=np.uint8)
    base = 0
    for s in streams:
        first, samples, md5 = header(s)
        heads.append(md5)
        counts.append(samples // BLOCK)
        own, body = scan(s, first, range(counts[-1]))
        starts += [base + x for x in own]
        bodies += [base + x for x in body]
        base += len(s)
        stops += starts[len(starts) - counts[-1] + 1 :] + [base]
    payload = bytes_of(data, *(np.array(x, dtype=np.int64) for x in (starts, bodies, stops)))
    out, at = [], 0
    for n, md5 in zip(counts, heads):
        p = payload[at : at + n * BLOCK]
        if hashlib.md5((np.frombuffer(p, dtype=np.uint8) ^ 0x80).tobytes()).digest() != md5:
            raise FlacError("MD5 of the samples")
        out.append(p)
        at += n * BLOCK
    return out


def read_at(stream: bytes, first: int, n: int) -> bytes:
    """Samples first to first + n of a stream (fewer at its end), of which only the frames that
    hold them are decoded, found from the last seek point before them."""
    at, samples, _ = header(stream)
    last = min(first + n, samples)
    if first >= last:
        return b""
    frame, byte, place = 0, at, 4
    while place < at:
        kind, size = stream[place] & 0x7F, int.from_bytes(stream[place + 1 : place + 4], "big")
        if kind == 3:
            for p in range(place + 4, place + 4 + size, 18):
                sample, offset, _ = struct.unpack(">QQH", stream[p : p + 18])
                if sample <= first:
                    frame, byte = sample // BLOCK, at + offset
        place += 4 + size
    stop = -(-last // BLOCK)
    more = stop * BLOCK < samples
    starts, bodies = scan(stream, byte, range(frame, stop + more))
    stops = starts[1:] if more else starts[1:] + [len(stream)]
    skip = first // BLOCK - frame
    cut = slice(skip, stop - frame)
    got = bytes_of(np.frombuffer(stream, dtype=np.uint8), *(np.array(x[cut], dtype=np.int64) for x in (starts, bodies, stops)))
    return got[first % BLOCK : first % BLOCK + last - first]


def payload(text: str | None) -> bytes:
    b = (text or "").encode("utf-8", "surrogatepass")
    return b + b" " * (BLOCK - len(b) if len(b) < BLOCK else -len(b) % BLOCK)


def blocks(p: bytes, samples: int = SEEK * BLOCK) -> Iterator[tuple[int, bytes]]:
    """(first sample, samples as unsigned bytes) of a payload's PCM blocks."""
    for at in range(0, len(p), samples):
        yield at, p[at : at + samples]


def digests(pcm: Iterable[tuple[int, bytes]]) -> tuple[int, str, int, str]:
    """(bytes, SHA-256, CRC-32 of the last 16, feature) of PCM blocks in order of their
    offsets. The feature: mean, root mean square and zero crossings of the samples, from exact
    sums of whole numbers."""
    n, sha, tail, total, square, crossings, last = 0, hashlib.sha256(), b"", 0, 0, 0, None
    for first, p in pcm:
        if first != n:
            raise FlacError("a PCM block is missing")
        x = np.frombuffer(p, dtype=np.uint8).astype(np.int64) - 128
        low = x < 0
        crossings += int((low[1:] != low[:-1]).sum()) + (last is not None and bool(low[0]) != last)
        total, square, last = total + int(x.sum()), square + int((x * x).sum()), bool(low[-1])
        sha.update(p)
        n, tail = n + len(p), (tail + p[-16:])[-16:]
    return n, sha.hexdigest(), zlib.crc32(tail), f"mean={total / n:.4f};rms={(square / n) ** 0.5:.4f};crossings={crossings}"


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the texts as FLAC streams."""
    def rows(b):
        texts = [payload(t) for t in b["text"]]
        return zip(b["doc_id"], (len((t or "").encode("utf-8", "surrogatepass")) for t in b["text"]), encode(texts))
    return map_rows(docs.select("doc_id", "text"), rows, "doc_id long, n_bytes long, media binary")


def pcm_blocks(media: DataFrame, samples: int = SEEK * BLOCK) -> DataFrame:
    """doc_id, block, first_sample, n_samples, pcm (unsigned bytes): the media column decoded
    into blocks, each of which can be sought by its first sample."""
    def rows(b):
        for i, p in zip(b["doc_id"], decode(b["media"])):
            for at, pcm in blocks(p, samples):
                yield i, at // samples, at, len(pcm), pcm
    return map_rows(media.select("doc_id", "media"), rows, "doc_id long, block long, first_sample long, n_samples long, pcm binary", text="media")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rows(b):
        streams = encode([payload(t) for t in b["text"]])
        for i, t, s, p in zip(b["doc_id"], b["text"], streams, decode(streams)):
            n = len((t or "").encode("utf-8", "surrogatepass"))
            size, sha, tail, feature = digests(blocks(p))
            yield i, n, size, sha, tail, len(s), hashlib.sha256(s).hexdigest(), feature
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), rows, schema)
