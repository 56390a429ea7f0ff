"""Toxicity by a linear-chain conditional random field over words.

Two states, plain and toxic, in one chain over all words of a text. A word's evidence is a
sum of weights of hashed features: the word, its first 4 and 6 bytes, its last 4 bytes, and
its neighbours; the chain adds weights for each pair of successive states. Training tokens
are labelled from labelled documents: a word of a toxic document is toxic where the word or
one of its prefixes stands in a far larger share of toxic than of clean training documents,
by more than chance explains (DISCOVERY). Weights follow the gradient of the conditional
log-likelihood (forward-backward).

A text's score is a logistic function of what the squares of its marginals add up to
(the number of toxic words, their share, the surest word), fitted on a quarter of the sample
with a chain fitted on the others (the chain in use is fitted on all of it), clean and toxic
documents weighted as in the whole training fold. Words whose marginal is at least a half are reported, neighbours joined, with
their places in code points.

The model is fitted on a bounded sample: SAMPLE toxic and SAMPLE clean training documents,
those with the smallest MD5 of their id, and of these as many as have SAMPLE_CHARS characters
together. Equal texts count once, and so do texts that share most of their words: a group of
copies would make each of its words look typical. Scoring covers every whole text.

Forward-backward works on blocks of RUN words at once: the product of a block's transfer
matrices carries messages from block to block, so that no text is cut.

Defined results: a null or empty text has score by its (zero) sums, as any text without
toxic words; with no labelled toxic or no clean document every score is 0; labels other
than 0 and 1, null ones included, are not learned from; a doc_id with several labels counts
as toxic if one is; each row of docs stands for itself; other columns are kept by reject()
and ignored by score().
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lantern.llm.batches import map_rows
from lantern.llm.wordhash import MARKS, U, Words, lowered, mixed
from lantern.session import table, written

SAMPLE = 1000
SAMPLE_CHARS = 8_000_000
BITS = 18
RUN = 64
#: Documents of a training step.
GROUP = 125
EPOCHS, RATE, DECAY = 8, 0.15, 1e-5
#: A feature marks toxic words at these odds; this share of such features may be due to chance.
LEAST_ODDS, DISCOVERY = 8.0, 0.05
#: Texts are alike if they share this part of the SKETCH smallest hashes of their words.
SKETCH, ALIKE = 48, 0.5


def features(w: Words) -> np.ndarray:
    """(features, words) numbers below 2**BITS."""
    word = w.hashes()
    n = len(word)
    before, after = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
    if n > 1:
        same = w.doc[1:] == w.doc[:-1]
        before[1:] = np.where(same, word[:-1], U(0))
        after[:-1] = np.where(same, word[1:], U(0))
    parts = [word, w.hash(w.start, np.minimum(w.start + 4, w.end)), w.hash(w.start, np.minimum(w.start + 6, w.end)), w.hash(np.maximum(w.end - 4, w.start), w.end), before, after]
    return np.stack([(mixed(p + U(i + 1)) >> U(64 - BITS)).astype(np.int32) for i, p in enumerate(parts)])


def texts_of(first: np.ndarray) -> np.ndarray:
    """The text of each word, from each text's first word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


class Chain:
    """Forward-backward over the words of each text. Score of a path: evidence of its toxic
    words plus a weight for each pair of successive states (pairs[from, to]).

    Words lie in blocks of RUN (a column each). A block that begins a text is entered from
    both states alike, without a pair's weight."""

    def __init__(self, first: np.ndarray):
        doc = texts_of(first)
        self.blocks = -(-np.diff(first) // RUN)
        self.begin = np.concatenate([[0], np.cumsum(self.blocks)])
        place = np.arange(len(doc)) - first[doc]
        self.row, self.col = self.begin[doc] + place // RUN, place % RUN
        n = int(self.begin[-1])
        self.size = np.bincount(self.row, minlength=n)
        self.inside = np.arange(RUN)[:, None] < self.size[None]
        self.heads = np.zeros(n, dtype=bool)
        self.heads[self.begin[:-1][self.blocks > 0]] = True

    def entered(self, product: np.ndarray, back: bool) -> np.ndarray:
        """(2, blocks): the message that each block gets from the one before, or behind."""
        out = np.ones((2, product.shape[2]))
        begin, blocks = self.begin[:-1], self.blocks
        for k in range(1, int(blocks.max(initial=0))):
            on = blocks > k
            at = (self.begin[1:][on] - 1 - k) if back else begin[on] + k
            near = at + 1 if back else at - 1
            m, p = out[:, near], product[:, :, near]
            x = np.stack([p[i, 0] * m[0] + p[i, 1] * m[1] if back else m[0] * p[0, i] + m[1] * p[1, i] for i in (0, 1)])
            out[:, at] = x / x.sum(axis=0)
        return out

    def marginals(self, evidence: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of toxic for each word, and expected counts of pairs."""
        n = len(self.size)
        odds = np.ones((RUN, n))
        odds[self.col, self.row] = np.exp(np.clip(evidence, -30, 30))
        m = np.exp(pairs)
        # The weight of a step into a block's first word, and its product over the block.
        into = np.where(self.heads, 1.0, m[:, :, None])
        p = np.stack([into[:, 0], into[:, 1] * odds[0]], axis=1)
        for t in range(1, RUN):
            q = np.stack([p[:, 0] * m[0, 0] + p[:, 1] * m[1, 0], (p[:, 0] * m[0, 1] + p[:, 1] * m[1, 1]) * odds[t]], axis=1)
            p = np.where(self.inside[t], q / q.sum(axis=(0, 1)), p)
        left, right = self.entered(p, False), self.entered(p, True)
        a = np.empty((RUN, 2, n))
        for t in range(RUN):
            x, w = (left, into) if t == 0 else (a[t - 1], m)
            x = np.stack([x[0] * w[0, 0] + x[1] * w[1, 0], (x[0] * w[0, 1] + x[1] * w[1, 1]) * odds[t]])
            a[t] = x / x.sum(axis=0)
        out, expected = np.empty((RUN, n)), np.zeros((2, 2))
        b = right
        for t in range(RUN - 1, -1, -1):
            y = a[t] * b
            out[t] = y[1] / (y[0] + y[1])
            # The step into word t, from the word before or the block before.
            on = self.inside[t] if t else ~self.heads
            x = a[t - 1] if t else left
            near = np.stack([b[0], b[1] * odds[t]])
            joint = x[:, None] * m[:, :, None] * near[None]
            expected += (joint / joint.sum(axis=(0, 1)))[:, :, on].sum(axis=2)
            if t:
                back = np.stack([m[i, 0] * near[0] + m[i, 1] * near[1] for i in (0, 1)])
                b = np.where(on, back / back.sum(axis=0), b)
        return out[self.col, self.row], expected


def token_labels(f: list[np.ndarray], firsts: list[np.ndarray], toxic: list[np.ndarray]) -> list[np.ndarray]:
    """For groups of texts: 1 for words of toxic documents that carry a feature typical of them."""
    n1, n0 = (max(1, sum(int(x.sum()) for x in side)) for side in (toxic, [~x for x in toxic]))
    ln = lambda x: np.log(np.maximum(x, 1e-300))
    odd, apart, seen = [], [], 0
    for i in range(3):  # the word and its prefixes
        t, c = np.zeros(1 << BITS), np.zeros(1 << BITS)
        for x, first, y in zip(f, firsts, toxic):
            at = np.unique(texts_of(first) * (1 << BITS) + x[i])
            docs, feature = at >> BITS, at & (1 << BITS) - 1
            t += np.bincount(feature[y[docs]], minlength=1 << BITS)
            c += np.bincount(feature[~y[docs]], minlength=1 << BITS)
        # Bound on the chance of t toxic among t + c documents: exp(-(t + c) KL(share, n1 of all)).
        share, q = t / np.maximum(t + c, 1), n1 / (n1 + n0)
        odd.append((t / n1) / ((c + 0.5) / n0) >= LEAST_ODDS)
        apart.append(np.where(odd[i], t * ln(share / q) + c * ln((1 - share) / (1 - q)), 0.0))
        seen += np.count_nonzero(t + c)
    # Of the features taken, a share of DISCOVERY may be there by chance (Benjamini-Hochberg).
    best = np.sort(np.concatenate(apart))[::-1][:seen]
    enough = np.nonzero(best >= ln(seen / (DISCOVERY * np.arange(1, len(best) + 1))))[0]
    least = best[enough[-1]] if len(enough) else np.inf
    hit = [np.zeros(x.shape[1], dtype=bool) for x in f]
    for i in range(3):
        typical = odd[i] & (apart[i] >= least)
        for h, x in zip(hit, f):
            h |= typical[x[i]]
    return [h & y[texts_of(first)] for h, first, y in zip(hit, firsts, toxic)]


def sums(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, 5): what the score of a text is made of. A word counts by the square of its
    marginal: the small ones of a long text don't add up."""
    p = p * p
    n_docs, length, doc = len(first) - 1, np.diff(first), texts_of(first)
    total = np.bincount(doc, p, minlength=n_docs)
    none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=n_docs)
    two = np.minimum(total, 4.0)
    return np.stack([np.ones(n_docs), np.log1p(total), 1 - np.exp(none), two, np.log1p(1000 * total / np.maximum(length, 1))], axis=1)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def unlike(texts: list[str]) -> list[int]:
    """Numbers of texts that are not alike to an earlier one kept."""
    seen: dict[int, list[int]] = {}
    kept = []
    for i, t in enumerate(texts):
        w = Words([lowered(t)], MARKS)
        own = np.unique(w.hashes())[:SKETCH].tolist()
        shared: dict[int, int] = {}
        for h in own:
            for j in seen.get(h, ()):
                shared[j] = shared.get(j, 0) + 1
        if own and max(shared.values(), default=0) < ALIKE * len(own):
            kept.append(i)
            for h in own:
                seen.setdefault(h, []).append(i)
    return kept


def fit_chain(f: list[np.ndarray], firsts: list[np.ndarray], toxic: list[np.ndarray]) -> dict:
    """Feature weights, bias and pair weights of groups of texts."""
    y = token_labels(f, firsts, toxic)
    theta, pairs = np.zeros(1 << BITS), np.zeros((2, 2))
    bias = -3.0
    state = [np.zeros((1 << BITS) + 5) for _ in range(2)]
    step = 0
    for _ in range(EPOCHS):
        for own, first, hit in zip(f, firsts, y):
            if not own.shape[1]:
                continue
            chain, labels, n_docs = Chain(first), hit.astype(np.float64), len(first)
            p, expected = chain.marginals(theta[own].sum(axis=0) + bias, pairs)
            diff = (labels - p) / n_docs
            grad = np.zeros((1 << BITS) + 5)
            for row in own:
                grad[: 1 << BITS] += np.bincount(row, diff, minlength=1 << BITS)
            grad[: 1 << BITS] -= DECAY * theta
            grad[1 << BITS] = diff.sum()
            follow = np.ones(len(labels), dtype=bool)
            follow[first[:-1][np.diff(first) > 0]] = False
            seen = np.bincount((labels[:-1] * 2 + labels[1:])[follow[1:]].astype(int), minlength=4)
            grad[-4:] = (seen - expected.reshape(-1)) / n_docs
            step += 1
            state[0] = 0.9 * state[0] + 0.1 * grad
            state[1] = 0.99 * state[1] + 0.01 * grad * grad
            move = RATE * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-6)
            theta += move[: 1 << BITS]
            bias += move[1 << BITS]
            pairs += move[-4:].reshape(2, 2)
    return {"theta": theta.astype(np.float32), "pairs": pairs, "bias": bias}


def evidence(model: dict, f: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each word's marginal probability of toxic."""
    if not f.shape[1]:
        return np.zeros(0)
    return Chain(first).marginals(model["theta"][f].sum(axis=0) + model["bias"], model["pairs"])[0]


def fit(texts: list[str], toxic: np.ndarray, weight: np.ndarray) -> dict:
    """The model of a sample: feature weights, pair weights, and weights of the sums."""
    # The driver holds six small integers a word of the sample, and else one group's arrays.
    f, firsts, kinds = [], [], []
    for i in range(0, len(texts), GROUP):
        w = Words([lowered(t) for t in texts[i : i + GROUP]], MARKS)
        f.append(features(w))
        firsts.append(w.first)
        kinds.append(toxic[i : i + GROUP])
        w.release()
    # Few texts make one group; it is then the group of the sums, too.
    cut = max(1, 3 * len(f) // 4)
    model = fit_chain(f[:cut], firsts[:cut], kinds[:cut])
    rest = cut if cut < len(f) and len({*np.concatenate(kinds[cut:]).tolist()}) == 2 else 0
    x = np.concatenate([sums(evidence(model, own, first), first) for own, first in zip(f[rest:], firsts[rest:])])
    beta = np.zeros(x.shape[1])
    target, weight = np.concatenate(kinds[rest:]).astype(np.float64), weight[rest * GROUP :]
    for _ in range(25):  # Newton's method
        p = logistic(x @ beta)
        r = weight * p * (1 - p)
        beta += np.linalg.solve((x * r[:, None]).T @ x + 1e-2 * np.eye(x.shape[1]), x.T @ (weight * (target - p)) - 1e-2 * beta)
    return (fit_chain(f, firsts, kinds) if rest else model) | {"beta": beta}


def learn(docs: DataFrame, labels: DataFrame) -> dict | None:
    """The model learned from docs (doc_id, text) with labels (doc_id, toxic)."""
    known = labels.filter("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.filter("text <> ''").select("doc_id", F.length("text").alias("chars"), F.xxhash64("text").alias("h")).join(known, "doc_id")
    per = rows.groupBy("toxic", "h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"), F.max("chars").alias("chars"))
    per = written(per.withColumn("key", F.md5(F.col("doc_id").cast("string"))), "texts")
    size = {r["toxic"]: r["n"] for r in per.groupBy("toxic").agg(F.sum("n").alias("n")).collect()}
    if len(size) < 2:
        return None
    # Ids first: what is sent to the driver is the sample's texts and nothing else.
    chosen = [per.filter(F.col("toxic") == k).orderBy("key", "doc_id").limit(SAMPLE) for k in (0, 1)]
    upto = Window.partitionBy("toxic").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # SAMPLE rows each
    ids = chosen[0].unionByName(chosen[1]).withColumn("upto", F.sum("chars").over(upto)).withColumn("one", F.row_number().over(upto))
    ids = written(ids.filter((F.col("upto") <= SAMPLE_CHARS) | (F.col("one") == 1)).select("doc_id", "toxic", "h"), "sample")
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").filter(F.xxhash64("text") == F.col("h"))
    sample = sorted(sample.select("toxic", "doc_id", "text").collect(), key=lambda r: (r["toxic"], r["doc_id"], r["text"]))
    order = np.random.default_rng(0).permutation(len(sample))
    sample = [sample[i] for i in order]
    texts = [r["text"] for r in sample]
    kept = unlike(texts)
    toxic = np.array([sample[i]["toxic"] == 1 for i in kept])
    if len({*toxic.tolist()}) < 2:
        return None
    weight = np.where(toxic, size[1] / toxic.sum(), size[0] / (~toxic).sum())
    return fit([texts[i] for i in kept], toxic, weight / weight.mean())


def marked(w: Words, p: np.ndarray) -> list[list[tuple[int, int]]]:
    """Runs of toxic words of each text, in code points of the text."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(w.first) - 1)]
    at = np.nonzero(p >= 0.5)[0]
    if len(at):
        points = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
        base = points[w.begin]
        last = -2
        for i in at.tolist():
            d = int(w.doc[i])
            s, e = int(points[w.start[i]] - base[d]), int(points[w.end[i]] - base[d])
            if i == last + 1 and out[d]:
                out[d][-1] = (out[d][-1][0], e)
            else:
                out[d].append((s, e))
            last = i
    return out


def scored(model: dict, texts: list[str | None]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Scores and marked places of texts."""
    w = Words([lowered(t) for t in texts], MARKS)
    p = evidence(model, features(w), w.first)
    return logistic(sums(p, w.first) @ model["beta"]), marked(w, p)


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, score, spans array<struct<start, end>>: a row for each row of docs."""
    def rows(b):
        if model is None:
            return [(i, 0.0, []) for i in b["doc_id"]]
        return [(i, float(x), [{"start": a, "end": e} for a, e in m]) for i, x, m in zip(b["doc_id"], *scored(model, b["text"]))]
    return map_rows(docs.select("doc_id", "text"), rows, "doc_id long, score double, spans array<struct<start: long, end: long>>")


def reject(docs: DataFrame, model: dict | None, threshold: float = 0.5) -> DataFrame:
    """docs without the rows that score threshold or more."""
    names = docs.columns
    def rows(b):
        every = zip(*(b[c] for c in names))
        return every if model is None else (r for r, x in zip(every, scored(model, b["text"])[0]) if x < threshold)
    return map_rows(docs, rows, docs._jdf.schema().toDDL())


def training_fold(docs: DataFrame) -> DataFrame:
    return docs.filter(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 != 0)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(training_fold(docs), training_fold(table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    predicted = F.col("score") >= 0.5
    # Offending places, of the documents that are found toxic.
    spans = F.when(predicted, F.col("spans")).otherwise(F.array().cast("array<struct<start: bigint, end: bigint>>"))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", predicted.cast("int").alias("predicted"), spans.alias("spans"))
