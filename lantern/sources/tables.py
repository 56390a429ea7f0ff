"""Graphs inside ordinary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lantern.graph import Graph
from lantern.session import table


def nation_trade(spark: SparkSession, sf_dir: str) -> Graph:
    """Supplier nation -> customer nation, weighing the line items."""
    t = lambda name: table(spark, sf_dir, name)
    nation = lambda df, key, as_: df.select(key[0], F.col(key[1]).cast("long").alias(as_))
    # Nations first: what is dealt out is (order, supplier), and pairs are counted where they are.
    orders = t("orders").select("o_orderkey", "o_custkey").join(nation(t("customer"), ("c_custkey", "c_nationkey"), "dst"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "dst")
    lines = t("lineitem").select("l_orderkey", "l_suppkey").join(nation(t("supplier"), ("s_suppkey", "s_nationkey"), "src"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "src")
    e = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return Graph.from_edges(e, t("nation").select(F.col("n_nationkey").alias("id")))


def customer_supplier(spark: SparkSession, sf_dir: str, by: str | None = None) -> Graph:
    """Customer -> supplier they buy from; suppliers' ids follow the customers'. by: the end
    whose edges lie together."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    offset = table(spark, sf_dir, "customer").agg((F.max("c_custkey") + 1).alias("o"))
    e = lines.select("l_orderkey", "l_suppkey").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    e = e.join(F.broadcast(offset)).select(F.col("o_custkey").cast("long").alias("src"), (F.col("l_suppkey") + F.col("o")).cast("long").alias("dst"))  # one row
    # Distinct pairs are the graph's edges as they are: no sum of weights deals them out again.
    e = e.filter("src <> dst")
    e = (e.repartition(by) if by else e).distinct().withColumn("weight", F.lit(1.0))
    return Graph(e, e.select(F.explode(F.array("src", "dst")).alias("id")).distinct())


def event_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, weight) between event types that follow each other for a user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("event_type", F.lead("event_type").over(w).alias("next")).filter("next IS NOT NULL")
    return e.groupBy(F.col("event_type").alias("src"), F.col("next").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, href, n): links of each page."""
    p = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return p.groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


def turn_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, weight) between roles of successive turns."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").select("role", F.lead("role").over(w).alias("next")).filter("next IS NOT NULL")
    return t.groupBy(F.col("role").alias("src"), F.col("next").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))
