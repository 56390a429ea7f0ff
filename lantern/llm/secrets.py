"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

Candidates are runs of 20 and more characters of the base64 alphabet (with - and _), cut
behind each = that is no padding. Parts between slashes that placeholders fill or that are a
UUID, and words and numbers of more than SHORT characters, are allowed and left out; what
stands between them is a candidate unless it is words and numbers alone. A window of 20
characters slides along it; the counts of its characters and the sum of c * log2(c) over
them change by one character in and one out a step, and give the window's Shannon entropy.
If some window reaches the threshold of its class (hexadecimal, one case with digits, both
cases, both with digits), all parts between slashes that the candidate touches, and those
beside them that are no words, are a span of kind entropy, with their padding. Spans of the fixed patterns always stay.

Defined results: null and empty texts have no spans; each row stands for itself, equal rows
and equal ids included; positions are code points, ends exclusive; other columns are ignored
by scan() and kept by redact().
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lantern.llm.batches import map_rows
from lantern.session import table

#: Order of kinds where spans start at one place.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# Runs that are long enough; a shorter run holds no match, whatever place one starts at.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")

WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/=_-]{20,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]+(?:={1,2}(?![A-Za-z0-9+/=_-]))?")
#: Bits per character from which a window counts, by class: at most 1 in 100 random strings
#: of the class's alphabet has fewer in 20 characters.
THRESHOLD = {"hex": 2.8, "one case": 3.4, "letters": 3.58, "base64": 3.64}
#: Characters up to which a word or number can as well be a piece of a random string.
SHORT = 4
#: Words also joined by their capitals; of two letters only those that are common in names.
WORD = re.compile(r"(?:[a-z]++|[A-Z]++|(?:A[nst]|B[ey]|D[bo]|Go|I[dfnopst]|My|No|O[fnrs]|To|U[ips]|[A-Z]{0,5}+[a-z]{2,}+)++[A-Z]{0,5}+)[0-9]{0,4}|[0-9]+")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
PLACEHOLDER = re.compile(r"example|placeholder|changeme|dummy|sample|x{4,}+", re.IGNORECASE)
C_LOG_C = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def windows(s: str) -> Iterator[tuple[int, float]]:
    """The start and the bits a character of each window of s."""
    counts: dict[str, int] = {}
    total = 0.0
    for i, x in enumerate(s):
        c = counts.get(x, 0)
        counts[x] = c + 1
        total += C_LOG_C[c + 1] - C_LOG_C[c]
        if i < WINDOW - 1:
            continue
        yield i - WINDOW + 1, math.log2(WINDOW) - total / WINDOW + 1e-9
        gone = s[i - WINDOW + 1]
        c = counts[gone]
        counts[gone] = c - 1
        total += C_LOG_C[c - 1] - C_LOG_C[c]


def high_entropy(s: str, threshold: float) -> Iterator[tuple[int, int]]:
    """Stretches of s covered by windows with at least threshold bits a character."""
    start, end = -1, -1
    for i, bits in windows(s):
        if bits >= threshold:
            if start >= 0 and i > end:
                yield start, end
                start = -1
            start, end = (i if start < 0 else start), i + WINDOW
    if start >= 0:
        yield start, end


def least(window: str) -> float:
    """The threshold of the class that a window's characters are of."""
    if all(x in "0123456789abcdefABCDEF" for x in window):
        return THRESHOLD["hex"]
    upper, lower, digit = (any(a <= x <= z for x in window) for a, z in ("AZ", "az", "09"))
    if upper and lower:
        return THRESHOLD["base64" if digit else "letters"]
    return THRESHOLD["one case"] if digit else math.inf


def stands_in(part: str) -> bool:
    """Whether a part is a UUID, or at least half of its letters and digits are placeholders."""
    return bool(UUID.fullmatch(part)) or 2 * sum(len(m[0]) for m in PLACEHOLDER.finditer(part)) >= sum(x.isalnum() for x in part)


def candidates(token: str) -> Iterator[tuple[int, int]]:
    """Stretches of a token between what is allowed, that are not words and numbers alone."""
    start, end, random = -1, -1, False
    for part in re.finditer(r"[^/=]+", token):
        allowed = stands_in(part[0])
        for m in [part] if allowed else re.finditer(r"[A-Za-z0-9]+", part[0]):
            word = allowed or WORD.fullmatch(m[0])
            if word and (allowed or len(m[0]) > SHORT):
                if random:
                    yield start, end
                start, random = -1, False
                continue
            a = m.start() + (0 if allowed else part.start())
            start, end, random = (a if start < 0 else start), a + len(m[0]), random or not word
    if random:
        yield start, len(token) if not token[end:].strip("+/=_-") else end


def unlike_words(part: str) -> bool:
    """Whether a part between slashes is neither allowed nor words and numbers alone."""
    return not stands_in(part) and any(not WORD.fullmatch(x) for x in re.findall(r"[A-Za-z0-9]+", part))


def entropy_spans(token: str) -> list[tuple[int, int]]:
    """Stretches of a token that look random, by whole parts. What one has taken in is not
    walked again for the next: time follows the token's length."""
    out: list[tuple[int, int]] = []
    lead = len(token) - len(token.lstrip("/"))
    for a, b in candidates(token):
        before = out[-1][1] if out else 0
        if b <= before:
            continue
        s = token[a:b]
        if len(s) < WINDOW or not any(bits >= THRESHOLD["base64"] or bits >= THRESHOLD["hex"] and bits >= least(s[i : i + WINDOW]) for i, bits in windows(s)):
            continue
        a = token.rfind("/", before, a) + 1 or before
        b = len(token) if (k := token.find("/", b)) < 0 else k
        a = a if a > lead else 0
        # Parts next to it that are no words belong to it, if too short for a window.
        while a > max(1, before) and unlike_words(token[(k := token.rfind("/", 0, a - 1) + 1) : a - 1]):
            a = k
        while b < len(token):
            k = len(token) if (k := token.find("/", b + 1)) < 0 else k
            if not unlike_words(token[b + 1 : k].rstrip("=")):
                break
            b = k
        if out and a <= before:
            a = out.pop()[0]
        out.append((a, b))
    return out


def spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text as (kind, start, end), by start and then kind."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    for m in CANDIDATE.finditer(text):
        for t in TOKEN.finditer(m[0]):
            found += [("entropy", m.start() + t.start() + a, m.start() + t.start() + b) for a, b in entropy_spans(t[0])]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>>: a row for each row of docs."""
    return map_rows(
        docs.select("doc_id", "text"),
        lambda b: [(i, [{"kind": k, "start": s, "end": e} for k, s, e in spans(t or "")]) for i, t in zip(b["doc_id"], b["text"])],
        "doc_id long, spans array<struct<kind: string, start: long, end: long>>",
    )


def redacted(text: str | None, mark: str) -> str | None:
    if not text or not (found := spans(text)):
        return text
    out, at = [], 0
    for _, s, e in found:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret (overlapping spans as one) replaced by mark, and n_chars anew."""
    names = docs.columns
    def rows(b):
        b["text"] = [redacted(t, mark) for t in b["text"]]
        if "n_chars" in b:
            b["n_chars"] = [n if t is None else len(t) for n, t in zip(b["n_chars"], b["text"])]
        return zip(*(b[c] for c in names))
    return map_rows(docs, rows, docs._jdf.schema().toDDL())


def listed(found: Column) -> Column:
    part = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    return F.concat_ws(",", F.transform(found, part))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.col("spans")
    n = lambda k: F.size(F.filter(found, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", *(n(k) for k in KINDS[:3]),
        F.sha2(listed(F.filter(found, lambda x: x["kind"] != "entropy")), 256).alias("base_sha256"),
        listed(found).alias("spans"), n("entropy"),
    )
