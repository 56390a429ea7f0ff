"""Chat trees, hard negatives, periodic runs and media streams against brute force, SQL and odd tables."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lantern.llm import chats, media, negatives, runs
from lantern.llm.wordhash import SPACE, Words

SF = "/root/testdata/sf0.001"


def sql(query, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t)
    return con.sql(query)


def same(got, want):
    columns = sorted(got.columns)
    a = sorted(map(str, (tuple(r) for r in got.select(*columns).collect())))
    b = sorted(map(str, want.select(*(f'"{c}"' for c in columns)).fetchall()))
    assert a == b


# Chat trees

TEXTS = ["hi", "", None, "a <|im_end|>\n<|im_start|>user\nb", "<\\|x <\\\\| <", "|im_end|>", "é " * 30, "<|im_end|>"]
ROLES = ["user", "assistant", "system", None, "as\\n\nsistant", "<|im_start|>assistant"]


def talk():
    r = random.Random(5)
    rows = []
    for c in range(60):
        n = r.choice([1, 2, 3, 7])
        for t in range(n):
            k = r.randrange(2) if r.random() < 0.8 else r.randrange(len(TEXTS))
            role = ROLES[t % 2] if r.random() < 0.8 else r.choice(ROLES)
            rows.append((c, t, role, TEXTS[k], 7))
    rows += [(100, t, *x) for t, x in enumerate([("user", "one", 1), ("assistant", "two", 1)])]
    rows += [(101, t, *x) for t, x in enumerate([("user", "one", 1), ("assistant", "two", 1), ("user", "three", 1)])]
    rows += [(102, t, *x) for t, x in enumerate([("user", "one", 1), ("assistant", "two", 1)])]
    rows += [(None, 0, "user", "one", 1), (None, None, "user", "first", 1), (103, 4, "user", "twice", 1), (103, 4, "user", "twice", 1)]
    rows += [(104, t, "assistant", f"turn {t % 3}", 1) for t in range(400)]
    return rows


def formatted(role, text):
    esc = lambda s: __import__("re").sub(r"<(\\*)\|", lambda m: "<\\" + m[1] + "|", s)
    return f"<|im_start|>{esc(role.replace(chr(92), chr(92) * 2).replace(chr(10), chr(92) + 'n'))}\n{esc(text)}<|im_end|>\n"


@pytest.fixture(scope="module")
def packed(spark):
    df = spark.createDataFrame(talk(), "conv_id long, turn long, role string, text string, n_turns int")
    return df, chats.pack(df)


def test_chat_tree_emits_each_prefix_once_and_reads_back(spark, packed):
    df, p = packed
    by = {}
    for c, t, role, text, _ in talk():
        by.setdefault(c, []).append((t is not None, t, role or "", text or ""))
    by = {c: [x[2:] for x in sorted(v, key=lambda x: (x[0], x[1] or 0, x[2], x[3]))] for c, v in by.items()}
    nodes = p.nodes.orderBy("number").collect()
    prefixes = {tuple(v[: i + 1]) for v in by.values() for i in range(len(v))}
    assert len(nodes) == len(prefixes)
    assert [n.number for n in nodes] == list(range(len(nodes)))
    sequence = "".join(n.formatted for n in nodes)
    at = 0
    for n in nodes:
        assert (n.start, n.end) == (at, at + len(n.formatted))
        at = n.end
    got = {r.conv_id: r for r in p.conversations.collect()}
    assert set(got) == set(by)
    for c, v in by.items():
        whole = "".join(formatted(*x) for x in v)
        assert "".join(sequence[x.start : x.end] for x in got[c].intervals) == whole
        assert (got[c].n_turns, got[c].size) == (len(v), len(whole))
        seen = [n for x in got[c].intervals for n in nodes[x.first : x.last]]
        assert [n.position for n in seen] == [sum(len(formatted(*y)) for y in v[:i]) for i in range(len(v))]
        assert [chats.unescape(n.formatted[n.loss_start : n.loss_end]) for n in seen if n.loss_start is not None] == [x[1] for x in v if x[0] == "assistant"]
        assert {n.conv_id for n in nodes[got[c].intervals[0].first : got[c].intervals[0].last]} == {got[c].tree}


def test_chat_tree_is_depth_first(packed):
    """Each subtree is one stretch: what a conversation sees, then all that goes on from it."""
    _, p = packed
    paths = {}
    for r in p.conversations.collect():
        own = [n for x in r.intervals for n in range(x.first, x.last)]
        assert own == sorted(own)
        for i, n in enumerate(own):
            paths.setdefault(n, set()).update(own[i:])
    assert all(max(x) - n + 1 == len(x) for n, x in paths.items())


def test_chat_digests_against_sql(spark, packed):
    df, p = packed
    given = df.toArrow()
    want = sql(chats.SQL.replace("UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'", "").replace("ORDER BY turn,", "ORDER BY turn NULLS FIRST,"), conversations=given)
    same(chats.digests(chats.read_back(p)), want)


def test_chat_query(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    got = chats.op11_chats(spark, SF)
    same(got, con.sql(chats.SQL))


def test_chat_empty_table(spark):
    p = chats.pack(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert chats.digests(chats.read_back(p)).count() == 0


def test_chat_tokens(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.WordLevel({"hi": 0, "yes": 1, "[U]": 2}, unk_token="[U]"))
    t.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    t.save(str(tmp_path / "t.json"))
    df = spark.createDataFrame([(1, 0, "user", "hi hi yes"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi hi yes"), (2, 1, "assistant", "hi there yes")], "conv_id long, turn long, role string, text string")
    p = chats.pack(df, tokenizer=str(tmp_path / "t.json"))
    nodes = p.nodes.orderBy("number").collect()
    assert len(nodes) == 3 and all(n.end - n.start == len(n.tokens) for n in nodes)
    assert [n.position for n in nodes] == [0, len(nodes[0].tokens), len(nodes[0].tokens)]


# Hard negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score double"


def vectors():
    r = np.random.default_rng(3)
    near = r.normal(size=8)
    rows = [(i, (near + r.normal(size=8) * 0.4).astype(np.float32).tolist(), int(r.integers(3)), 1.0) for i in range(400)]
    rows += [(1000 + i, rows[0][1], 1 + i % 2, 1.0) for i in range(40)]  # copies: ties
    nan, inf = float("nan"), float("inf")
    rows += [(2000, None, 1, 0.0), (2100, [nan] + [0.0] * 7, 1, 0.0), (2200, [inf] + [0.0] * 7, 1, 0.0), (2300, [None] + [0.0] * 7, 1, 0.0), (2400, rows[5][1], None, 0.0), (None, rows[5][1], 1, 0.0)]
    return rows + [(2500, [0.0] * 8, 0, 0.0), (2600, (-near).astype(np.float32).tolist(), 9, 0.0), (2601, (-near * 2).astype(np.float32).tolist(), 9, 0.0)]


def query(df, **options):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(df.withColumn("label", label.cast("int")), F.col("vec_id") % 100 == 0, **options)


@pytest.mark.parametrize("block", [negatives.BLOCK, 8 * 8 * 3])
def test_negatives_against_sql(spark, block):
    df = spark.createDataFrame(vectors(), SCHEMA).repartition(3)
    got = query(df, block=block)
    want = sql(negatives.SQL, embeddings=df.toArrow())
    same(got, want)
    assert got.count() > 50


def test_negatives_dealt_out_by_work(spark, monkeypatch):
    monkeypatch.setattr(negatives, "WORK", 5000)
    monkeypatch.setattr(negatives, "CELLS", 40)
    df = spark.createDataFrame(vectors(), SCHEMA)
    same(query(df), sql(negatives.SQL, embeddings=df.toArrow()))


def test_negatives_repeated_rows_count_once(spark):
    df = spark.createDataFrame(vectors(), SCHEMA)
    same(query(df.union(df).union(df)), sql(negatives.SQL, embeddings=df.toArrow()))


def test_negatives_beyond_float(spark):
    big = [(0, [2.0**40, 1.0], 1), (1, [2.0**14, 0.5], 1), (2, [2.0**14, 0.25], 2), (3, [2.0**14, 0.5 + 2**-7], 2), (4, [-(2.0**60), 0.0], 2), (5, [2.0**14, 0.25, 9.0], 2), (6, [], 2)]
    rows = negatives.mine(spark.createDataFrame(big, "vec_id long, embedding array<double>, label int"), F.col("vec_id") == 0).orderBy("rank").collect()
    exact = lambda v: 2**48 * 2**22 + 256 * int(256 * v)
    held = lambda v: min(exact(v), 2**63 - 1)
    assert [(r.positive_id, r.negative_id, r.negative_score) for r in rows] == [(1, i, held(v)) for i, v in [(2, 0.25), (3, 0.5), (5, 0.25)]]


def test_negatives_empty(spark):
    assert negatives.mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0).count() == 0
    alone = spark.createDataFrame([(0, [1.0], 1, 0.0), (1, [1.0], 2, 0.0)], SCHEMA)
    assert negatives.mine(alone, F.col("vec_id") == 0).count() == 0


# Periodic runs


def slow_runs(w, shortest=12):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            s = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(shortest, 2 * q):
                out.setdefault((s, i + q), q)
            i += i == s
    return sorted((s, e - s, q) for (s, e), q in out.items())


def own_runs(w, shortest=12):
    x = Words([b" ".join(w)], SPACE)
    s, e, q = runs.runs(runs.Text(x.data, x.start, x.end), x.hashes(), shortest)
    return list(zip(s.tolist(), (e - s).tolist(), q.tolist()))


def some_words(r, n):
    a = r.choice([1, 2, 3, 6])
    w = [b"abcdef"[x : x + 1] for x in (r.randrange(a) for _ in range(n))]
    if n and r.random() < 0.6:
        s = r.randrange(n)
        p = 1 + r.randrange(max(1, (n - s) // 3))
        w = [w[i] if i < s else w[s + (i - s) % p] for i in range(n)]
    return w


def test_runs_against_brute_force():
    r = random.Random(1)
    for _ in range(800):
        w, k = some_words(r, r.randrange(70)), r.choice([12, 5, 2])
        assert own_runs(w, k) == slow_runs(w, k)


def test_runs_in_parts_of_the_grid(monkeypatch):
    monkeypatch.setattr(runs, "PAIRS", 300)
    monkeypatch.setattr(runs, "KEPT", 64)
    monkeypatch.setattr(runs, "_grid", None)
    r = random.Random(2)
    for _ in range(60):
        w = some_words(r, r.randrange(400))
        assert own_runs(w) == slow_runs(w)


def test_runs_where_hashes_lie():
    """Prefix hashes modulo a power of two take stretches of the Thue-Morse word for others."""
    w = [b"ab"[bin(i).count("1") % 2 :][:1] for i in range(1 << 13)]
    x = Words([b" ".join(w)], SPACE)
    t = runs.Text(x.data, x.start, x.end)
    found = own_runs(w, 2)
    s, e, q = runs.by_words(t.numbered(), 2)
    assert found == list(zip(s.tolist(), (e - s).tolist(), q.tolist()))
    assert max(length / q for _, length, q in found) == 2  # it holds no cube, and no overlap


def test_long_texts_take_seconds():
    import time

    for w in ([b"x"] * 100_000, [b"w%d" % (i * i % 1_000_003) for i in range(300_000)], ([b"a"] * 30 + [b"b"]) * 4000):
        began = time.time()
        own_runs(w)
        assert time.time() - began < 30


def slow_query(doc_id, text):
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", text or "") if x]
    h, n = (zlib.crc32(str(doc_id).encode()), len(w)) if doc_id is not None else (1, len(w))
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = slow_runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *four, digest("".join(f"{s},{n},{q}\n" for s, n, q in found)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_query_against_brute_force(spark):
    got = sorted(tuple(r) for r in runs.op13_runs(spark, SF).collect())
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    short = {i: t for i, t in docs if len((t or "").split()) < 1500}
    assert len(got) == len(docs) and len(short) > 150
    assert [g for g in got if g[0] in short] == sorted(slow_query(i, t) for i, t in short.items())
    assert sum(g[1] > 0 for g in got) > len(docs) / 12


def test_runs_odd_tables(spark):
    texts = [None, "", " \t\n\x0b\x0c\r ", "a " * 11, "a " * 12, "é b " * 40, "x y " * 6, "a b\x85c " * 30]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "q " * 30, 1), (5, texts[5], 1), (5, "no", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = sorted((tuple(r) for r in runs.find(df, prepare=runs.planted).collect()), key=str)
    assert got == sorted((slow_query(i, t) for i, t, _ in rows), key=str)
    assert runs.find(df.limit(0)).count() == 0
    assert {(r.doc_id, r.start, r.length, r.period) for r in runs.listed(df).collect()} >= {(4, 0, 12, 1), (6, 0, 12, 2)}
    assert {r.doc_id: r.text for r in runs.collapse(df).collect() if r.doc_id in (3, 4, 6)} == {3: " ".join("a" * 11), 4: "a", 6: "x y"}


# Long input in time that follows its length


def times(function, unit, sizes=(40_000, 160_000)):
    import time

    out = []
    for n in sizes:
        text = unit * (n // len(unit))
        began = time.perf_counter()
        function(text)
        out.append(time.perf_counter() - began)
    return out


@pytest.mark.parametrize("unit", ["<div>", "<div>a", "<p>a<div>", "<li>x<div>", "<div></foo>", "<tr><div>", "<b><option>"])
def test_nested_pages_take_linear_time(unit):
    from lantern.llm import htmltext

    short, long = times(lambda t: htmltext.main_text(t, {p: None for _, p, *_ in htmltext.styles(t)[:3]}), unit)
    assert long < 12 * short + 0.5  # four times as long; a quadratic one takes sixteen times


def test_deep_page_gives_its_text(spark):
    from lantern.llm import htmltext

    deep = "<div>" * 100_000 + "<p>Words at the bottom</p>"
    df = spark.createDataFrame([(1, "http://a/", deep), (2, "http://a/", deep + "more")], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in htmltext.extract(df).collect()} == {1: "Words at the bottom", 2: "Words at the bottom\n\nmore"}


@pytest.mark.parametrize("unit", ["Zq9Kx7Lm2Pw4Rt6Yv8Bn/password/", "Zq9Kx7Lm2Pw4Rt6Yv8Bn-password-", "Zq9Kx7Lm2Pw4Rt6Yv8Bn/", "a1B2/", "password/"])
def test_tokens_of_many_parts_take_linear_time(unit):
    from lantern.llm import secrets

    short, long = times(secrets.spans, unit, (60_000, 240_000))
    assert long < 12 * short + 0.3


# Prefix hashes that occur again


def test_jaccard_filter_lets_every_repeated_hash_pass(spark, monkeypatch):
    """With every bit set all hashes pass: the results are the same."""
    from lantern.llm import jaccard

    r = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(r.choices(words, k=40)) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t + " end") for i, t in enumerate(texts[:30])] + [(200 + i, texts[0]) for i in range(20)] + [(300, None), (301, ""), (None, texts[1]), (302, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, jaccard.join(df, n=4, percent=85).collect()), key=str)
    same(spark.createDataFrame([x for x in whole if x[0] is not None], "doc_id long, n_shingles long, component_id long"), sql(jaccard.SQL, documents=df.filter("doc_id IS NOT NULL").toArrow()))
    monkeypatch.setattr(jaccard, "bitmap", lambda x, bits: np.full(1 << bits - 3, 255, dtype=np.uint8))
    assert sorted(map(tuple, jaccard.join(df, n=4, percent=85).collect()), key=str) == whole


def payloads_of_media():
    r = np.random.default_rng(3)
    wave = (60 * np.sin(np.arange(192 * 700) / 7) + 128 + r.integers(-3, 4, 192 * 700)).astype(np.uint8).tobytes()
    return [media.payload("the quick brown fox jumps over the lazy dog " * 900), wave, r.integers(0, 256, 192 * 20, dtype=np.uint8).tobytes(), b"\x00\xff" * 96 * 5, media.payload("")]


def test_fitted_predictors_are_written_and_read():
    payloads = payloads_of_media()
    streams = media.encode(payloads)
    assert media.decode(streams) == payloads and [media.encode([p])[0] for p in payloads] == streams
    kinds = []
    for s in streams:
        first, samples, _ = media.header(s)
        kinds.append({s[b] >> 1 for b in media.scan(s, first, range(samples // 192))[1]})
    assert 35 in kinds[0] & kinds[1] and kinds[2] == {1} and kinds[4] == {0}
    assert 3 * len(streams[1]) < 2 * len(payloads[1])


def test_samples_are_sought_from_seek_points():
    payloads = payloads_of_media()
    for p, s in zip(payloads, media.encode(payloads)):
        for first, n in ((0, 1), (0, len(p)), (191, 2), (len(p) - 1, 10), (len(p), 5), (len(p) // 2, 1000), (512 * 192 - 1, 2), (600 * 192, 7)):
            assert media.read_at(s, first, n) == p[first : first + n]
    bad = bytearray(media.encode(payloads)[1])
    bad[len(bad) // 2] ^= 1
    at = next(i for i in range(0, len(payloads[1]), 192 * 20) if not sought(bytes(bad), i))
    assert at > 0 and sought(bytes(bad), 0)


def sought(stream, first):
    try:
        return media.read_at(stream, first, 192 * 20) is not None
    except media.FlacError:
        return False


def test_digests_of_blocks_are_those_of_the_whole():
    for p in payloads_of_media():
        whole = media.digests([(0, p)])
        assert whole[:3] == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        for size in (7, 192, 1000):
            assert media.digests(media.blocks(p, size)) == whole
    with pytest.raises(media.FlacError):
        media.digests(list(media.blocks(payloads_of_media()[0], 1000))[1:])
