"""The registered queries over small tables: every column that they are bound to return, with
nulls, empty texts and repeated rows."""

import hashlib
import random
import re
import zlib

import duckdb

from lantern.llm import jaccard, language, licenses, media, mixing


def prose(seed, n, words=200):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def saved(spark, folder, rows, schema="doc_id long, text string"):
    spark.createDataFrame(rows, schema).write.parquet(str(folder / "documents.parquet"))
    return str(folder)


def by_sql(folder, sql, columns):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return sorted(con.sql(f"SELECT {columns} FROM ({sql})").fetchall())


def test_mixing_query(spark, tmp_path):
    rows = [(i, prose(i, 3 + i % 9), [None, "b", "a", "c", "b"][i % 5]) for i in range(200)] + [(200, None, "a"), (201, "", None), (202, prose(7, 300), "zz")]
    got = mixing.op1_mixing(spark, saved(spark, tmp_path, rows, "doc_id long, text string, source string")).collect()
    assert [r["doc_id"] for r in sorted(got)] == list(range(203))
    size = {i: len((t or "").split()) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sum(n for i, n in size.items() if source[i] == source[r["doc_id"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"] + 1e-6
    for s in set(source.values()):
        own = [r for r in got if source[r["doc_id"]] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)


def test_jaccard_query(spark, tmp_path):
    rng = random.Random(2)
    texts = [None, "", "one two", "One\ttwo", "x", prose(3, 400)]
    for i in range(8):
        base = prose(50 + i, 60, 4000).split()
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    folder = saved(spark, tmp_path, list(enumerate([*texts, texts[9], texts[9].upper()])))
    got = jaccard.op2_jaccard(spark, folder).select("doc_id", "n_shingles", "component_id").collect()
    want = by_sql(folder, jaccard.SQL, "doc_id, n_shingles, component_id")
    assert sorted(map(tuple, got)) == want and len({c for _, _, c in want}) < len(want)


def test_licenses_query(spark, tmp_path):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    mit = licenses.TEMPLATES["mit"][0]
    texts = [None, "", "CC BY", "cc-by 4.0, cc  by", "accc by", "General\nPublic License. All rights reserved; CC BY", "café cc by écc by", mit, f"{prose(1, 50)} {mit} all rights reserved", "x " * 20000 + "cc by"]
    rows = [*enumerate(texts), (5, texts[5])]
    got = sorted(licenses.op3_licenses(spark, saved(spark, tmp_path, rows)).collect(), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in got] == sorted(i for i, _ in rows)
    for r in got:
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in texts[r["doc_id"]] or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        base = [(i, label) for phrase, label in phrases.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        at = [i for i, _ in base]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(base), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in base}))
        labels = r["labels"].split(",")
        assert {x for _, x in base} <= set(labels) and labels == sorted(set(labels)) and 0 <= r["score"] <= 1
        assert ("mit" in labels) == (r["doc_id"] in (7, 8))


def test_language_query(spark, tmp_path):
    say = lambda letters, i: " ".join("".join(random.Random(i * 99 + k).choice(letters) for _ in range(5)) for k in range(20))
    rows = [(i, say("abcde", i) if i % 2 else say("mnopq", i), "xx" if i % 2 else "yy") for i in range(60)] + [(60, None, "xx"), (61, "", "yy"), (62, "12 34", "yy"), (63, say("abcde", 7), None)]
    schema = "doc_id long, text string, lang string"
    got = {r["doc_id"]: r for r in language.op7_language(spark, saved(spark, tmp_path / "a", rows, schema)).collect()}
    held_out = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in rows}
    assert {i: r["held_out"] for i, r in got.items()} == held_out and set(held_out.values()) == {True, False}
    assert all(got[i]["lang_pred"] == y and 0 <= got[i]["score"] <= 1 for i, _, y in rows[:60])
    assert [got[i]["lang_pred"] for i in (60, 61, 62, 63)] == ["und", "und", "und", "xx"]
    # Neither the texts nor the languages of the held-out fold reach the prototypes.
    other = [(i, t, "zz" if held_out[i] else y) for i, t, y in rows]
    again = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.op7_language(spark, saved(spark, tmp_path / "b", other, schema)).collect()}
    assert again == {i: (r["lang_pred"], r["score"]) for i, r in got.items()}


def test_media_query(spark, tmp_path):
    texts = [None, "", "abc", "é" * 96, "x" * 192, "x" * 193, prose(2, 20000), "abc"]
    got = {r["doc_id"]: r for r in media.op9_media(spark, saved(spark, tmp_path, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        whole = raw.ljust(192 * max(1, -(-len(raw) // 192)), b" ")
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), len(whole), zlib.crc32(whole[-16:]))
        assert r["payload_sha256"] == hashlib.sha256(whole).hexdigest()
        stored = media.encode([whole])[0]
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert got[0][1:] == got[1][1:] and got[2][1:] == got[7][1:] and all(r["feature"] for r in got.values())


def test_queries_of_empty_tables(spark, tmp_path):
    folder = saved(spark, tmp_path, [], "doc_id long, text string, source string, lang string")
    for query in (mixing.op1_mixing, jaccard.op2_jaccard, licenses.op3_licenses, language.op7_language, media.op9_media):
        assert query(spark, folder).count() == 0
