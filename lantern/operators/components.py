"""Parts of graphs: the largest component, nodes with edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lantern.graph import Graph, reindex, relabel
from lantern.plans.components import components
from lantern.session import written


def member_table(g: Graph) -> DataFrame:
    """(id, component): every node and the smallest node of its weakly connected component."""
    found = components(g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return g.nodes.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def dense(g: Graph, kept: DataFrame) -> Graph:
    """The part of g on the nodes kept (id), renumbered from 0 in the order of ids."""
    index = reindex(kept, "id")
    return Graph(relabel(g.edges, index, "id"), index.select(F.col("index").alias("id")))


def largest_component(g: Graph, renumber: bool = True) -> Graph:
    """The largest weakly connected component (of two, that with the smallest node), renumbered
    or with the ids it has in g."""
    m = written(member_table(g), "members")
    top = m.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    kept = m.join(F.broadcast(top), "component").select("id")  # one row
    # An edge lies in its source's component.
    return dense(g, kept) if renumber else Graph(g.edges.join(kept, F.col("src") == F.col("id"), "left_semi"), kept)


def without_isolated(g: Graph) -> Graph:
    """g without the nodes that have no edge, renumbered."""
    return dense(g, g.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct())
