import pytest

from lantern.operators import mail, report
from lantern.sources import edges, sinks
from lantern.streaming import mail as stream


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_text_graphs(spark, tmp_path):
    p = tmp_path / "a.edgelist"
    p.write_text("%4\n0 1 2.5\n1 2\n\n2 2 1\n")
    assert edges.node_count(spark, str(p)) == 4
    g = edges.graph(spark, str(p), weighted=True)
    assert rows(g.edges) == [(0, 1, 2.5), (1, 2, 1.0)] and g.nodes.count() == 4
    c = tmp_path / "a.csv"
    c.write_text("#3\n0,1\n0,1\n")
    assert rows(edges.graph(spark, str(c)).edges) == [(0, 1, 2.0)]
    with pytest.raises(ValueError):
        edges.file_kind("a.xml")


def test_last_row_of_a_pair_counts(spark, tmp_path):
    lines = [f"{i % 7} {(i * 3 + 1) % 11} {i}" for i in range(4000)]
    p = tmp_path / "many.edgelist"
    p.write_text("\n".join(["%11", *lines]))
    want, both = {}, {}
    for x in lines:
        a, b, w = map(int, x.split())
        if a != b:
            want[a, b] = w
            both[a, b] = both[b, a] = w
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")  # the file is read in many splits
    try:
        got = rows(edges.graph(spark, str(p), weighted=True, last=True).edges)
        undirected = rows(edges.graph(spark, str(p), weighted=True, directed=False, last=True).edges)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted((a, b, float(w)) for (a, b), w in want.items())
    assert undirected == sorted((a, b, float(w)) for (a, b), w in both.items())
    # One file after the other, by name.
    (tmp_path / "parts.tsv").mkdir()
    (tmp_path / "parts.tsv" / "a.tsv").write_text("0\t1\t5\n")
    (tmp_path / "parts.tsv" / "b.tsv").write_text("0\t1\t3\n1\t2\t1\n")
    assert rows(edges.graph(spark, str(tmp_path / "parts.tsv"), weighted=True, last=True).edges) == [(0, 1, 3.0), (1, 2, 1.0)]
    spark.createDataFrame([(0, 1, 2.0), (0, 1, 9.0)], "a long, b long, w double").coalesce(1).write.parquet(str(tmp_path / "e.parquet"))
    assert rows(edges.graph(spark, str(tmp_path / "e.parquet"), weighted=True, last=True).edges) == [(0, 1, 9.0)]


def test_round_trips(spark, tmp_path):
    e = spark.createDataFrame([(0, 1, 1.5), (2, 0, 1.0)], "src long, dst long, weight double")
    sinks.edges(e, str(tmp_path / "o.tsv"), 5)
    g = edges.graph(spark, str(tmp_path / "o.tsv"), weighted=True)
    assert rows(g.edges) == rows(e) and g.nodes.count() == 5
    a = spark.createDataFrame([(0, 2), (1, 0)], "g2_node long, g1_node long")
    sinks.alignment(a, str(tmp_path / "al"), 3, 2)
    got, n1, n2 = edges.alignment(spark, str(tmp_path / "al"))
    assert rows(got) == rows(a) and (n1, n2) == (3, 2)
    (tmp_path / "l.json").write_text('{"1": "x", "2": null}')
    assert rows(edges.labels(spark, str(tmp_path / "l.json"))) == [(1, "x")]
    many = spark.createDataFrame([(i, f'a "{i}" \\ b') for i in range(10)], "node long, label string")
    sinks.labels(many, str(tmp_path / "labels"))
    assert rows(edges.labels(spark, str(tmp_path / "labels"))) == rows(many)
    (tmp_path / "wide.json").write_text('{\n  "3": "x",\n  "4": null,\n  "5": "y z"\n}')
    assert rows(edges.labels(spark, str(tmp_path / "wide.json"))) == [(3, "x"), (5, "y z")]
    assert sinks.parameter_name("a", {"k": 1}) == sinks.parameter_name("a", {"k": 1})


def test_mail(spark):
    head = "Message-ID: <1>\nDate: today\nFrom: "
    text = head + "'a@x.org'\r\nTo: \"b@y.org\", <c@z.org>;\n\tb@y.org,\n\td@y.org\nSubject: to e@y.org\nCc: none\n\n" + "\n" * 15 + "Bcc: f@y.org\nBcc: late@y.org"
    m = spark.createDataFrame([("p", text), ("q", "no header"), ("r", None), ("s", head + "a@x.org, b@x.org\nTo: c@x.org"), ("t", head + "A <a@x.org>\nTo: c@x.org\n")], "path string, text string")
    parsed = mail.parsed(m)
    assert {r["path"]: (r["sender"], sorted(r["recipients"])) for r in parsed.collect()} == {"p": ("a@x.org", ["b@y.org", "c@z.org", "d@y.org", "f@y.org"]), "t": ("a@x.org", ["c@x.org"])}
    assert rows(mail.edges(parsed)) == [("a@x.org", x, 1) for x in ("b@y.org", "c@x.org", "c@z.org", "d@y.org", "f@y.org")]
    assert rows(mail.repeated_ids(parsed)) == [("<1>", 2)]
    e, roles, index = mail.dataset(m, spark.createDataFrame([("a", "boss"), ("z", "clerk")], "prefix string, role string"), "x.org")
    place = dict(rows(index))
    assert sorted(place.values()) == list(range(7)) and (place["a@x.org"], place["b@y.org"], 1) in rows(e) and rows(roles) == sorted([(place["a@x.org"], "boss"), (place["z@x.org"], "clerk")])


def test_kinds_of_addresses(spark):
    a = spark.createDataFrame([(x,) for x in ("jane.doe@in.org", "a1b2c3d4e5f6@in.org", "12345678@home.net", "x@sub.free.net", "prof@cs.some.edu", "clerk@irs.gov", "jane.doe@postmaster.net", "jane.doe@else.org", "jane.doe@Gate.org")], "a string")
    args = (["in.org"], ["home.net"], ["free."], ("gate",))
    from pyspark.sql import functions as F

    assert [r[0] for r in a.select(mail.kind(F.col("a"), *args)).collect()] == ["inside", "bot", "bot", "private", "university", "government", "bot", None, "bot"]
    assert [r[0] for r in a.select(mail.simple_kind(F.col("a"), ["in.org"], ("gate",))).collect()] == ["inside", "bot", "bot", "external", "external", "external", "bot", "external", "bot"]
    assert [r[0] for r in a.limit(1).select(mail.simple_role(F.lit("Trader"), {"Employee": ["Trader"]})).collect()] == ["Employee"]
    assert mail.exclusive(a, F.lit(True), F.lit(False)).first()["ok"] and not mail.exclusive(a, F.lit(True), F.lit(True)).first()["ok"]
    n = spark.createDataFrame([(1,), (2,)], "id long")
    assert rows(mail.described(n, n.filter("id = 1").selectExpr("id", "'r' AS role"), n.filter("id = 2").selectExpr("id", "'u@d.org' AS address"))) == [(1, "r", "Unknown"), (2, "Unknown", "d.org")]


def test_replay_nodes_and_catalogue(spark, tmp_path):
    sinks.replay(str(tmp_path / "r.json"), 64, True, 1e-6, {0: [True, False]})
    assert sinks.read_replay(str(tmp_path / "r.json")) == {"size": 64, "weights": True, "tol": 1e-6, "masks": {0: [True, False]}}
    n = spark.createDataFrame([(0,), (4,)], "id long")
    assert edges.selected(n, 5) is n
    with pytest.raises(ValueError):
        edges.selected(n, 4)
    p = tmp_path / "k.tsv"
    p.write_text("% a comment\n1 2\n1 2\n4 5\n2 3\n")
    g = edges.dataset(spark, str(p), "directed", largest=True)
    assert rows(g.edges) == [(0, 1, 2.0), (1, 2, 1.0)] and rows(g.nodes) == [(0,), (1,), (2,)]
    (tmp_path / "n.csv").write_text("x,3\ny,4\n")
    assert rows(edges.node_lookup(spark, str(tmp_path / "n.csv"), spark.createDataFrame([("y",)], "name string"))) == [("y", 4)]
    sinks.results(n, str(tmp_path / "res"))
    sinks.results(n, str(tmp_path / "res"), "overwrite")
    assert spark.read.json(str(tmp_path / "res")).count() == 2


def test_changes_names_and_records(spark):
    from pyspark.sql import functions as F

    x = spark.createDataFrame([(i, v) for i, v in enumerate("aabbbca")] + [(9, None), (10, None)], "i long, v string")
    assert rows(report.changes(x, "i", "v")) == [(0, "a"), (2, "b"), (5, "c"), (6, "a"), (9, None)]
    names = spark.createDataFrame([("n10",), ("n9",), ("n9.5",)], "name string")
    assert [r[0] for r in names.orderBy(report.natural_key(F.col("name"))).collect()] == ["n9", "n9.5", "n10"]
    assert [r[0] for r in names.limit(1).select(report.pretty_name(F.lit("heat_R3_T_x"), {"heat": "Heat", "R": "radius ", "T": ""})).collect()] == ["Heat radius 3 x"]
    rec = spark.createDataFrame([("a", "completed"), ("b", "oom"), ("c", "completed"), ("d", "completed")], "name string, status string")
    assert rows(report.processed(rec, {"c": "C", "a": "A", "b": "B"}).select("place", "name")) == [(0, "C"), (1, "A")]


def test_distribution(spark):
    x = spark.createDataFrame([(1.0,), (1.0,), (3.0,), (4.0,)], "v double")
    edf = report.cumulative_shares(x, "v")
    assert rows(edf) == [(1.0, 0.5), (3.0, 0.75), (4.0, 1.0)]
    draws = spark.createDataFrame([(0, 0.0), (1, 0.625)], "draw int, u double")
    assert rows(report.sample_distribution(edf, "v", draws)) == [(0, 1.0), (1, 2.0)]


def test_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    t = spark.createDataFrame([("2024-01-01 00:10:00", 1, 2), ("2024-01-01 00:20:00", 1, 2), ("2024-01-01 01:10:00", 2, 1)], "ts string, src long, dst long")
    t = t.withColumn("ts", F.to_timestamp("ts"))
    t.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    q = stream.edge_counts(s).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n"] for r in spark.table("counts").collect()) == [1, 2]
