"""Language identification with hyperdimensional n-gram profiles.

Each of 32 symbols (a place between words, and 31 classes of letters: a to z have their own,
other letters share them by code point) has a fixed random vector of +1 and -1. A trigram's
vector binds its letters by multiplication, the first permuted twice and the second once. A
document bundles (adds) the vectors of its trigrams, each as often as it occurs; a language's
prototype bundles its training documents, each scaled to one length. The language whose
prototype has the largest cosine with the document is predicted, and that cosine is the
score. Prototypes are compared after their common part (the mean over languages) is taken
from both sides, where there are two languages or more.

All training documents count. Sums are of integers, so reruns agree.

Defined results: null texts and texts without letters are `und` with score 0, as is every
text where nothing could be learned; ties go to the first language in code-point order;
documents with a null lang are not learned from; a null doc_id counts as the empty text in
the fold; each row stands for itself; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lantern.llm.batches import fold_rows, map_rows
from lantern.session import table

SYMBOLS = 32
DIMENSIONS = 1024
SEED = 7
SCALE = 1 << 16


@lru_cache(1)
def symbols() -> np.ndarray:
    """Symbol of each code point; 0: no letter."""
    out = np.zeros(0x110000, dtype=np.int32)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = c - 96 if 97 <= c <= 122 else c * 2654435761 % 4294967296 % (SYMBOLS - 1) + 1
    return out


@lru_cache(1)
def trigrams() -> np.ndarray:
    """The vector of each trigram."""
    letters = np.random.default_rng(SEED).integers(0, 2, (SYMBOLS, DIMENSIONS)).astype(np.int8) * 2 - 1
    first, second = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
    return (first[:, None, None] * second[None, :, None] * letters[None, None]).reshape(-1, DIMENSIONS)


def counts(text: str | None) -> np.ndarray | None:
    """How often each trigram about a letter occurs; None where there is no letter."""
    s = symbols()[np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    keep = s[1:-1] > 0
    if not keep.any():
        return None
    code = (s[:-2] << 10) + (s[1:-1] << 5) + s[2:]
    return np.bincount(code[keep], minlength=SYMBOLS**3)


def bundle(n: np.ndarray) -> np.ndarray:
    at = np.nonzero(n)[0]
    return n[at].astype(np.float32) @ trigrams()[at].astype(np.float32)


def prototypes(docs: DataFrame) -> dict[str, np.ndarray]:
    """Bundle of all docs of each lang. The driver gets 1,024 numbers a language."""
    def step(state, b):
        for lang, t in zip(b["lang"], b["text"]):
            n = counts(t)
            if n is not None:
                total = state.setdefault(lang, np.zeros(SYMBOLS**3, dtype=np.int64))
                total += np.rint(n * (SCALE / np.sqrt((n * n).sum()))).astype(np.int64)
    def finish(state):
        for lang, n in state.items():
            at = np.nonzero(n)[0]
            out = np.zeros(DIMENSIONS, dtype=np.int64)
            for i in range(0, len(at), 2048):
                out += n[at[i : i + 2048]] @ trigrams()[at[i : i + 2048]].astype(np.int64)
            yield lang, out
    parts = fold_rows(docs.filter("lang IS NOT NULL").select("lang", "text"), dict, step, finish, "lang string, v array<long>")
    sums = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select("lang", "v.x").collect()
    return {r["lang"]: np.array(r["x"], dtype=np.float64) for r in sorted(rows)}


def identify(docs: DataFrame, learned: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score: a row for each row of docs."""
    names = list(learned)
    p = np.array([v / max(np.linalg.norm(v), 1e-9) for v in learned.values()]).reshape(len(names), DIMENSIONS)
    common = p.mean(axis=0) if len(names) > 1 else np.zeros(DIMENSIONS)
    centred = p - common
    centred /= np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-9)
    axis = common / max(np.linalg.norm(common), 1e-9)

    def rows(b):
        for i, t in zip(b["doc_id"], b["text"]):
            n = counts(t) if names else None
            if n is None:
                yield i, "und", 0.0
                continue
            v = bundle(n).astype(np.float64)
            v -= (v @ axis) * axis
            cosine = centred @ v / max(np.linalg.norm(v), 1e-9)
            best = int(np.argmax(cosine))
            yield i, names[best], float(min(1.0, max(0.0, cosine[best])))

    return map_rows(docs.select("doc_id", "text"), rows, "doc_id long, lang_pred string, score double")


def fold(doc_id: Column, of: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % of


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 3) == 1
    got = identify(docs, prototypes(docs.filter(~held_out)))
    return got.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
