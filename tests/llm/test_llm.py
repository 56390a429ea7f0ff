"""The ten operators against brute force on small tables with nulls, ties, repeats, empty and
long texts, and columns whose names clash."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lantern.llm import decontaminate, htmltext, jaccard, language, licenses, media, mixing, secrets, suffixes, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size string, score string"


def table(spark, texts, **more):
    n = len(texts)
    cols = {"lang": ["en"] * n, "source": ["s"] * n} | more
    ids = more.get("doc_id", list(range(n)))
    return spark.createDataFrame([(ids[i], t, cols["lang"][i], cols["source"][i], None if t is None else len(t), "x", None) for i, t in enumerate(texts)], COLUMNS)


def prose(seed, n, words=200):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def test_mixing_meets_targets(spark):
    texts = [prose(i, 5 + i % 7) for i in range(300)] + [None, "", prose(1, 400)]
    sources = [["a", "b", None, "c"][i % 4] if i % 3 else "a" for i in range(303)]
    docs = table(spark, texts, source=sources)
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    size = [len((t or "").split()) for t in texts]
    total = {s: sum(z for z, x in zip(size, sources) if x == s) for s in set(sources)}
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free = {}, set(order)
    while True:
        left = sum(size) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * total[s]}
        if not over:
            target |= share
            break
        target |= {s: 3 * total[s] for s in over}
        free -= over
    assert len(got) == 303 and sum(r["taken"] for r in got.values()) == sum(size)
    for s in order:
        own = [i for i, x in enumerate(sources) if x == s]
        assert all(got[i]["target"] == pytest.approx(target[s]) and got[i]["source_size"] == total[s] for i in own)
        assert abs(sum(got[i]["taken"] for i in own) - target[s]) <= max(size[i] for i in own)
        assert all(0 <= got[i]["taken"] <= 3 * size[i] for i in own)
    assert mixing.mix(empty(spark)).count() == 0


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_jaccard_components(spark, n, percent):
    rng = random.Random(n)
    texts = [None, "", "one two", "one two", "ONE  two", "x"]
    for i in range(6):
        base = prose(100 + i, 60, 5000).split()
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(w[rng.randrange(3):]))
    texts += [texts[10], texts[10], prose(9, 3000)]
    def sets(t):
        w = (t or "").lower().split()
        return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    s = [sets(t) for t in texts]
    parent = list(range(len(texts)))
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(s)):
        for j in range(i):
            same = len(s[i] & s[j])
            if same and 100 * same >= percent * (len(s[i]) + len(s[j]) - same):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(table(spark, texts), n, percent).collect()}
    assert got == {i: (len(s[i]), find(i)) for i in range(len(s))}


def test_jaccard_edges(spark):
    assert jaccard.join(empty(spark)).count() == 0
    docs = table(spark, ["a b c d e f", "a b c d e f", "q"], doc_id=[None, 3, 4])
    assert sorted(jaccard.deduplicate(docs).columns) == sorted(docs.columns)
    assert jaccard.deduplicate(docs).count() == 3  # a null id is linked with nothing


def test_jaccard_bitmaps_bound():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    sets = [np.sort(x) for n in (0, 1, 31, 32, 33, 900, 5000) for x in (base[:n], np.concatenate([base[: n // 2], rng.integers(0, 1 << 63, n - n // 2, dtype=np.uint64)]))]
    bits = jaccard.bitmaps(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])]))
    for x, p in zip(sets, bits):
        for y, q in zip(sets, bits):
            assert len(np.intersect1d(x, y)) <= jaccard.most_shared(p, len(x), q, len(y)) <= min(len(x), len(y))
    assert jaccard.most_shared(bits[-1], 5000, bits[-2], 5000) < 4000  # they share 2,500


def test_licenses(spark):
    texts = [None, "", "All rights reserved, cc-by CC BY cc by.", prose(1, 50) + " This work is licensed under the GNU General Public License, version 3. " + prose(2, 50),
             "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"] + [prose(i, 30) for i in range(20)]
    got = {r["doc_id"]: r for r in licenses.scan(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower())
        base = sorted((p, label) for phrase, label in licenses.BASE.items() for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split())
        assert got[i]["n_words"] == len(w) and [(x["place"], x["label"]) for x in got[i]["base"]] == base
    assert "gpl" in got[3]["notices"] and "bsd" in got[4]["notices"] and not got[10]["notices"]
    assert licenses.scan(empty(spark)).count() == 0


def test_decontamination(spark):
    items = [prose(i, 12 + i, 3000) for i in range(6)] + ["too short", None, prose(50, 1100, 3000)]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    w = items[3].split()
    texts = [None, "", prose(60, 40, 3000), prose(61, 30) + " " + items[2].upper() + "! " + prose(62, 30), " ".join(w[:-1]), " ".join(["x", *w[1:]]), " ".join(w[:5]), items[8] + " " + prose(63, 10), items[0]]
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.find(table(spark, texts), bench).collect()}
    def sh(t):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower())
        return w
    want = {}
    for i, t in enumerate(texts):
        for j, item in enumerate(items[:7]):
            a, b = sh(t), sh(item)
            if len(b) < 5:
                continue
            bag = lambda x: [tuple(x[k : k + 5]) for k in range(len(x) - 4)]
            best = 0.0
            for s in range(-len(b) + 5, len(a)):
                x, y = bag(a[max(s, 0) : s + len(b)]), bag(b)
                common = sum(min(x.count(k), y.count(k)) for k in set(x))
                best = max(best, common / max(1, len(x) + len(y) - common))
            if best >= 0.8:
                want[i, j] = best
    assert {k: v for k, v in got.items() if k[1] < 7} == pytest.approx(want)
    assert (7, 8) in got
    assert decontaminate.find(empty(spark), bench).count() == 0
    assert sorted(r["doc_id"] for r in decontaminate.clean(table(spark, texts), bench).collect()) == sorted(set(range(9)) - {k[0] for k in got})


def test_html(spark):
    page = lambda body, menu="Home": f"<html><head><title>t</title><style>p{{}}</style></head><body><nav>{menu}</nav><div class='promo-x'>Same words</div><article><h1>A &amp; B</h1>{body}</article><div class=comments><p>no</p></div><footer>f</footer></body></html>"
    html = [page(f"<p>one {i}<br>two&nbsp;&#233;<p>three<script>var x='<p>';</script> <b>four</b></p>") for i in range(8)] + [None, "", "plain &lt;text", "<p>cut <b>off</b> at <a href='x", page("<aside>ad</aside><ul><li>x</li><li>y</ul>")]
    pages = spark.createDataFrame([(i, "http://h.example.com/" if i < 8 else None, h) for i, h in enumerate(html)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in htmltext.extract(pages).collect()}
    assert all(got[i] == f"A & B\n\none {i} two é\n\nthree four" for i in range(8))
    assert (got[8], got[9], got[10], got[11], got[12]) == ("", "", "plain <text", "cut off at", "A & B\n\nx\n\ny")


def test_style_tree_drops_what_a_host_repeats(spark):
    html = [f"<body><div class=top>Same words everywhere</div><div class=x><p>Page number {i} says {prose(i, 5)}</p></div></body>" for i in range(8)]
    pages = spark.createDataFrame([(i, "http://h.example.com/", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    assert all("Same words" not in r["text"] and "Page number" in r["text"] for r in htmltext.extract(pages).collect())


def test_toxicity_learns_words_and_prefixes(spark):
    rng = random.Random(0)
    texts, toxic = [], []
    for i in range(400):
        w = prose(i, 60, 300).split()
        if i % 4 == 0:
            for _ in range(4):
                w[rng.randrange(60)] = rng.choice(["stupid", f"lowei{rng.choice('abcdefghij')}"])
        texts.append(" ".join(w))
        toxic.append(int(i % 4 == 0))
    docs = table(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(toxic)] + [(0, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs.filter("doc_id < 300"), labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = range(300, 400)
    assert np.mean([(got[i]["score"] >= 0.5) == toxic[i] for i in held]) > 0.95
    assert got[400]["score"] < 0.5 and got[401]["score"] < 0.5
    for x in got[300]["spans"]:
        assert "stupid" in texts[300][x["start"] : x["end"]] or "lowei" in texts[300][x["start"] : x["end"]]
    assert toxicity.reject(docs, model).count() == sum(r["score"] < 0.5 for r in got.values())
    assert toxicity.learn(docs, labels.filter("toxic = 0")) is None


def test_forward_backward_is_the_sum_over_paths():
    import itertools

    rng = np.random.default_rng(0)
    first = np.array([0, 4, 4, 5])
    evidence, pairs = rng.normal(size=5), rng.normal(size=(2, 2))
    p, expected = toxicity.Chain(first).marginals(evidence, pairs)
    total, toxic, steps = 0.0, np.zeros(4), np.zeros((2, 2))
    for path in itertools.product((0, 1), repeat=4):
        s = np.exp(sum(evidence[i] for i in range(4) if path[i]) + sum(pairs[a, b] for a, b in zip(path, path[1:])))
        total += s
        toxic += s * np.array(path)
        for a, b in zip(path, path[1:]):
            steps[a, b] += s
    assert p[:4] == pytest.approx(toxic / total) and expected == pytest.approx(steps / total)
    assert p[4] == pytest.approx(1 / (1 + np.exp(-evidence[4])))


def test_forward_backward_is_one_chain_over_the_whole_text():
    rng = np.random.default_rng(1)
    lengths = [1, 63, 64, 65, 0, 128, 200, 1000]
    first = np.concatenate([[0], np.cumsum(lengths)])
    evidence, pairs = rng.normal(size=first[-1]), rng.normal(size=(2, 2)) * 2
    got, expected = toxicity.Chain(first).marginals(evidence, pairs)
    m, steps = np.exp(pairs), np.zeros((2, 2))
    for b, n in zip(first, lengths):
        o = np.stack([np.ones(n), np.exp(evidence[b : b + n])], axis=1)
        ahead, behind = np.ones((n, 2)), np.ones((n, 2))
        for t in range(n):
            x = (ahead[t - 1] @ m if t else 1) * o[t]
            ahead[t] = x / x.sum()
        for t in range(n - 2, -1, -1):
            x = m @ (o[t + 1] * behind[t + 1])
            behind[t] = x / x.sum()
        y = ahead * behind
        assert got[b : b + n] == pytest.approx(y[:, 1] / y.sum(axis=1))
        for t in range(1, n):
            joint = ahead[t - 1][:, None] * m * (o[t] * behind[t])[None]
            steps += joint / joint.sum()
    assert expected == pytest.approx(steps)


def test_copies_do_not_make_words_toxic(spark):
    """A toxic text with hundreds of near copies doesn't turn its harmless words toxic."""
    rng = random.Random(7)
    texts, toxic = [], []
    base = prose(999, 80, 100_000).split()
    for i in range(300):
        w = prose(i, 60, 300).split() if i % 3 else [*base[: rng.randrange(70, 80)], f"z{i}"]
        if i % 3 == 0 or i % 6 == 1:
            w += ["stupid", "loser"]
        texts.append(" ".join(w))
        toxic.append(int("stupid" in w))
    docs = table(spark, [*texts, " ".join(base[:50])])
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()}
    assert got[300] < 0.5 and all((got[i] >= 0.5) == (toxic[i] == 1) for i in range(300))


def test_toxicity_query(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, prose(i, 40, 300) + (" scum" * rng.randrange(2, 4) if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(200)] + [(200, None, 1), (201, "", 0)]
    spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r["doc_id"]: r for r in toxicity.op6_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == 202
    for i, t, y in rows:
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1
        assert not t or r["predicted"] == y
        assert bool(r["spans"]) == bool(t and y) and all(set(t[x["start"] : x["end"]].split()) == {"scum"} for x in r["spans"])
    # Rows of the held-out fold do not reach the model, whatever their labels say.
    flipped = [(i, y if zlib.crc32(str(i).encode()) % 5 else 1 - y) for i, _, y in rows]
    spark.createDataFrame(flipped, "doc_id long, toxic int").write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
    again = {r["doc_id"]: r["score"] for r in toxicity.op6_toxicity(spark, str(tmp_path)).collect()}
    assert again == {i: r["score"] for i, r in got.items()}
    assert toxicity.score(empty(spark), None).count() == 0 and toxicity.learn(empty(spark), spark.createDataFrame([], "doc_id long, toxic int")) is None


def test_language(spark):
    say = lambda letters, i: " ".join("".join(random.Random(i * 99 + k).choice(letters) for _ in range(5)) for k in range(30))
    texts = [say("abcde", i) if i % 2 else say("mnopq", i) for i in range(60)] + [None, "", "12 34", "mnopq" * 2000]
    langs = ["xx" if i % 2 else "yy" for i in range(60)] + [None, "xx", "xx", None]
    docs = table(spark, texts, lang=langs)
    learned = language.prototypes(docs.filter("doc_id % 3 <> 1"))
    got = {r["doc_id"]: r for r in language.identify(docs, learned).collect()}
    assert all(got[i]["lang_pred"] == langs[i] and 0 <= got[i]["score"] <= 1 for i in range(60))
    assert [got[i]["lang_pred"] for i in (60, 61, 62, 63)] == ["und", "und", "und", "yy"]
    assert language.identify(docs, {}).filter("lang_pred <> 'und'").count() == 0


def test_secrets(spark):
    key = "Zx9QwErT5yUiOp2AsDfGh7"
    texts = [None, "", 'é PASSWORD = "hunter2hunter2"', "token=secret: xyzabcdefghijkl", "AKIA" + "A1" * 8 + " AKIASHORT", "0123456789abcdef0 deadbeef", f"see {key} and {'word' * 10}", "550e8400-e29b-41d4-a716-446655440000", "example-xxxx-a1"]
    docs = table(spark, texts)
    got = {r["doc_id"]: [(x["kind"], x["start"], x["end"]) for x in r["spans"]] for r in secrets.scan(docs).collect()}
    def base(t):
        out = [("assign", *m.span()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 12]
        out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        return out + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    for i, t in enumerate(texts):
        assert [x for x in got[i] if x[0] != "entropy"] == sorted(base(t or ""), key=lambda x: (x[1], secrets.KINDS.index(x[0])))
    assert [x[0] for x in got[6]] == ["entropy"] and not got[7] and not got[8]
    assert secrets.scan(empty(spark)).count() == 0 and secrets.scan(docs.unionByName(docs)).count() == 2 * len(texts)
    clean = {r["doc_id"]: r for r in secrets.redact(docs).collect()}
    assert clean[2]["text"] == 'é [SECRET]"' and clean[2]["n_chars"] == 11 and clean[0]["text"] is None


def test_windowed_entropy_is_recounted():
    s = "".join(random.Random(1).choice("abcDEF0123456789") for _ in range(300))
    bits = lambda w: -sum(w.count(c) / 20 * np.log2(w.count(c) / 20) for c in set(w))
    covered = {j for i in range(281) if bits(s[i : i + 20]) >= 3.3 for j in range(i, i + 20)}
    assert {j for a, b in secrets.high_entropy(s, 3.3) for j in range(a, b)} == covered


def test_flac_round_trip(spark):
    rng = np.random.default_rng(0)
    payloads = [media.payload(None), media.payload("é" * 3000), b"x" * 192 * 300, rng.integers(0, 256, 192 * 150, dtype=np.uint8).tobytes(), media.payload(prose(1, 5000))]
    streams = media.encode(payloads)
    assert media.decode(streams) == payloads and streams[0][:4] == b"fLaC"
    for at in (30, len(streams[1]) // 2, len(streams[1]) - 1):
        bad = bytearray(streams[1])
        bad[at] ^= 1
        with pytest.raises(media.FlacError):
            media.decode([bytes(bad)])
    docs = table(spark, [None, "", "abc", prose(2, 40000)])
    blocks = media.pcm_blocks(media.store(docs), 19200).orderBy("doc_id", "block").collect()
    assert all(b["first_sample"] == b["block"] * 19200 for b in blocks)
    assert b"".join(b["pcm"] for b in blocks if b["doc_id"] == 3).rstrip(b" ") == prose(2, 40000).encode()


def test_lpc_subframe():
    """A frame written bit by bit with a linear predictor of order 2 and two partitions."""
    x = [int(60 * np.sin(i / 9)) for i in range(192)]
    coefficients, shift = [31, -16], 4
    e = [x[i] - ((coefficients[0] * x[i - 1] + coefficients[1] * x[i - 2]) >> shift) for i in range(2, 192)]
    bits = "0" + format(32 + 1, "06b") + "0" + "".join(format(v & 255, "08b") for v in x[:2]) + format(6 - 1, "04b") + format(shift, "05b") + "".join(format(c & 63, "06b") for c in coefficients) + "00" + "0001"
    for part in (e[:94], e[94:]):
        bits += "0010"
        for v in part:
            u = v * 2 if v >= 0 else -v * 2 - 1
            bits += "0" * (u >> 2) + "1" + format(u & 3, "02b")
    data = np.packbits(np.array([int(b) for b in bits + "0" * (-len(bits) % 8)], dtype=np.uint8))
    got, end = media.subframes(data, media.Bits(data), np.array([0]))
    assert got[0].tolist() == x and end[0] == len(data)


def test_suffix_array():
    rng = np.random.default_rng(0)
    for _ in range(200):
        s = rng.integers(1, int(rng.integers(2, 6)), int(rng.integers(0, 60))).astype(np.int64)
        assert suffixes.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_suffix_queries_of_odd_tables(spark, tmp_path):
    assert suffixes.deduplicate(empty(spark)).count() == 0
    text = prose(5, 80, 5000)
    spark.createDataFrame([(1, text), (2, "x" + text), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, suffixes.op10_suffixes(spark, str(tmp_path)).collect()))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    n = len(text)
    assert got == [(1, n, 0, 0, sha(text.encode())), (2, n + 1, n, 1, sha(b"x")), (3, 0, 0, 0, sha(b""))]


@pytest.mark.parametrize("crowd", [4 << 20, 1])
def test_repeated_passages(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffixes, "CROWDED", crowd)
    a, b = prose(1, 60, 5000), prose(2, 60, 5000)
    texts = [None, "", a, a, "ü" * 300, "x" * 99, b + " " + a[20:200] + " " + b, "zz " + a[5:160], "ab" * 200, a[:99], "q" + a[:120]]
    got = {r["doc_id"]: r for r in suffixes.deduplicate(table(spark, texts)).collect()}
    seen = set()
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(raw[p : p + 100])
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).digest()) == (len(raw), int(gone.sum()), runs, hashlib.sha256(kept).digest())


def test_pipeline_stages_keep_the_columns(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "mixing_to_weights"]
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = corpus_pipeline.run(spark, d)
    assert set(docs.columns) <= set(got.columns)
    rows = got.collect()
    assert 0 < len(rows) <= docs.count() and all(0 < r["taken"] <= 3 * r["size"] for r in rows)
