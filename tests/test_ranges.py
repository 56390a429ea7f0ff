"""Blocks of sources by order, steps dealt by ranges of ids, and parts of graphs with their ids."""

import os

from pyspark.sql import functions as F

from lantern.graph import Graph
from lantern.operators import lanes, mail, plane
from lantern.operators.components import largest_component
from lantern.operators.heat import heat_kernel
from lantern.session import CLEANUP, released, setting, written


def test_sources_of_one_part_share_blocks(spark):
    """40 parts of 16 sources: 40 blocks' rows, and not a row for each block and part."""
    ids = spark.range(640).select((F.col("id") * 7919 % 640).alias("id"))
    places = lanes.numbering(ids, lanes.LANES)
    assert places.select("block", F.floor(F.col("source") / 16).alias("part")).distinct().count() == 40
    assert places.count() == places.select("block", "lane").distinct().count() == 640


def test_a_node_goes_once_to_each_range(spark, monkeypatch):
    monkeypatch.setattr(lanes, "RANGE", 100)
    nodes = spark.range(400)
    where = lanes.ranges(nodes)
    assert where.count() == 400 and where.select("part").distinct().count() == 4
    edges = spark.range(399).select(F.lit(0).cast("long").alias("_s"), (F.col("id") + 1).alias("dst"))
    rows = lanes.dealt(edges, where).collect()
    assert len(rows) == 4 and sorted(x for r in rows for x in r["to"]) == list(range(1, 400))


def test_heat_over_several_ranges(spark, monkeypatch):
    """Equal weights or not, the sum is that of one range."""
    pairs = [(i, (i * k + 1) % 50, float(k)) for i in range(50) for k in (2, 3, 5)]
    g = Graph.from_edges(spark.createDataFrame(pairs, "src long, dst long, weight double"), 50)
    sources = spark.range(0, 50, 7)
    get = lambda: {(r.source, r.node): r.psi for r in heat_kernel(g, [1.0], 5, sources).collect()}
    one = get()
    monkeypatch.setattr(lanes, "RANGE", 9)
    more = get()
    assert one.keys() == more.keys() and all(abs(one[k] - more[k]) < 1e-12 for k in one)


def test_written_leaves_no_shuffle_files(spark):
    def files():
        local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for d in local for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}

    before = files()
    t = written(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
    assert files() <= before
    assert t.count() == 7
    released(t)
    with setting(spark, CLEANUP, "false"):
        pass
    assert spark.conf.get(CLEANUP) == "false"


def test_largest_component_with_its_ids(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (10, 14, 1.0), (14, 19, 2.0), (30, 33, 1.0)], "src long, dst long, weight double")
    g = Graph.from_edges(edges)
    part = largest_component(g, renumber=False)
    assert {tuple(r) for r in part.edges.collect()} == {(10, 14, 1.0), (14, 19, 2.0)}
    assert {r.id for r in part.nodes.collect()} == {10, 14, 19}
    assert {tuple(r) for r in largest_component(g).edges.collect()} == {(0, 1, 1.0), (1, 2, 2.0)}


def test_a_message_is_split_once(spark):
    """Filters on what stands in a message are not moved before its text is split."""
    m = spark.createDataFrame([("1", "Message-ID: <1>\nDate: x\nFrom: a@b.c\nTo: 'd@e.f',\n\tg@h.i\n\nHi")], "path string, text string")
    e = mail.edges(mail.parsed(m))
    assert {tuple(r) for r in e.collect()} == {("a@b.c", "d@e.f", 1), ("a@b.c", "g@h.i", 1)}
    plan = e._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Message-ID:") >= 1 and plan.count("(?:To|Cc|Bcc)") == 1


def test_rounds_of_a_layout_broadcast_nothing(spark):
    """A broadcast passes through the driver, in every round anew."""
    state = written(spark.range(50).select(F.col("id").alias("at"), F.col("id").alias("node"), F.rand(1).alias("x"), F.rand(2).alias("y"), F.lit(0).alias("round")))
    links = written(spark.range(49).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(1.0).alias("weight")))
    new = plane.moved(state, links, 50, 3, 5, 1.5, 0.9, 0)
    assert new.count() == 50
    assert "Broadcast" not in new._jdf.queryExecution().executedPlan().toString()
