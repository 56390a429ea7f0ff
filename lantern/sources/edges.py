"""Readers of graph files. Text has no header; columns go by position: src, dst[, weight]."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lantern.graph import Graph

KINDS = ("tsv", "csv", "parquet", "edgelist", "txt")


def file_kind(path: str) -> str:
    """Kind by extension; compression extensions are looked through."""
    name = re.sub(r"\.(gz|bz2|zst)$", "", path.rstrip("/").rsplit("/", 1)[-1])
    kind = name.rsplit(".", 1)[-1] if "." in name else ""
    if kind not in KINDS:
        raise ValueError(f"{path}: not one of {', '.join(KINDS)}")
    return kind


def node_count(spark: SparkSession, path: str) -> int | None:
    """N of a first line '%N' or '#N'."""
    if file_kind(path) == "parquet":
        return None
    first = spark.read.text(path).limit(1).collect()
    m = re.match(r"\s*[%#]\s*(\d+)\s*$", first[0]["value"]) if first else None
    return int(m[1]) if m else None


def edges(spark: SparkSession, path: str, weighted: bool = False, ordered: bool = False) -> DataFrame:
    """(src, dst, weight). Lines that begin with % or # are comments; missing weights are 1.
    ordered: with a column order, by file, the place of the split in it and that of the row in
    the split, so that rows can be told apart by which comes later, however files are split."""
    place = [F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("order")] if ordered else []
    kind = file_kind(path)
    if kind == "parquet":
        df = spark.read.parquet(path)
        c = [F.col(f"`{x}`") for x in df.columns]
        weight = c[2].cast("double") if weighted and len(c) > 2 else F.lit(1.0)
        return df.select(c[0].cast("long").alias("src"), c[1].cast("long").alias("dst"), weight.alias("weight"), *place)
    line = F.trim(F.col("value"))
    parts = F.split(line, r"\s*,\s*" if kind == "csv" else r"\s+")
    df = spark.read.text(path).filter((line != "") & ~line.rlike(r"^[%#]")).select(parts.alias("p"), *place)
    weight = F.coalesce(F.try_element_at("p", F.lit(3)).cast("double"), F.lit(1.0)) if weighted else F.lit(1.0)
    # Ids may be written as 3 or 3.0.
    return df.select(*[F.element_at("p", i + 1).cast("double").cast("long").alias(x) for i, x in enumerate(("src", "dst"))], weight.alias("weight"), *["order"] * ordered)


def graph(spark: SparkSession, path: str, directed: bool = True, weighted: bool = False, n: int | None = None, drop_loops: bool = True, one_based: bool = False, last: bool = False) -> Graph:
    """The canonical graph of a file, its nodes 0 .. n-1; n: given, from the file's first
    line, or the largest id and one. last: of several rows of a pair the last counts (in an
    undirected graph, of either direction), instead of their sum."""
    e = edges(spark, path, weighted, last)
    if one_based:
        e = e.withColumns({"src": F.col("src") - 1, "dst": F.col("dst") - 1})
    n = n or node_count(spark, path)
    if n is None:
        n = int(e.agg(F.max(F.greatest("src", "dst"))).first()[0] or -1) + 1
    if last and not directed:
        e = e.unionByName(e.withColumns({"src": F.col("dst"), "dst": F.col("src")}))
    return Graph.from_edges(e, n, directed, weighted, drop_loops, order_by="order" if last else None)


def labels(spark: SparkSession, path: str) -> DataFrame:
    """(node, label) of JSON objects {"node": "label", ...}, over one or many lines (a pair
    on one of them); null labels are left out."""
    string = r'"(?:[^"\\]|\\.)*"'
    pairs = F.regexp_extract_all("value", F.lit(rf"({string})\s*:\s*{string}"), F.lit(0))
    found = spark.read.text(path).select(F.explode(pairs).alias("p"))
    m = F.from_json(F.concat(F.lit("{"), "p", F.lit("}")), T.MapType(T.StringType(), T.StringType()))
    return found.select(F.explode(m).alias("node", "label")).select(F.col("node").cast("long").alias("node"), "label")


def roles(spark: SparkSession, path: str) -> DataFrame:
    """(node, label) of lines 'node label'."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter("trim(value) <> ''").select(p[0].cast("long").alias("node"), p[1].alias("label"))


def unique_labels(*tables: DataFrame) -> DataFrame:
    """(label): the distinct labels of training, test and other tables (node, label)."""
    out = tables[0].select("label")
    for t in tables[1:]:
        out = out.unionByName(t.select("label"))
    return out.distinct()


def labelled_graph(spark: SparkSession, edge_path: str, role_path: str, reverse: bool = False) -> tuple[Graph, DataFrame]:
    """A graph file and its nodes' (node, label) file; the graph's edges turned round on request."""
    r = roles(spark, role_path)
    g = Graph.from_edges(edges(spark, edge_path), r.select(F.col("node").alias("id")))
    return (g.reversed() if reverse else g), r


def people(spark: SparkSession, path: str, domain: str) -> DataFrame:
    """(prefix, role, address) of a CSV file with the header email_prefix, role."""
    p = spark.read.csv(path, header=True)
    return p.select(F.col("email_prefix").alias("prefix"), "role", F.concat("email_prefix", F.lit("@" + domain)).alias("address"))


def selected(nodes: DataFrame, n: int) -> DataFrame:
    """nodes (id), if all are among 0 .. n-1; ValueError otherwise."""
    wrong = nodes.filter((F.col("id") < 0) | (F.col("id") >= n)).limit(5).collect()
    if wrong:
        raise ValueError(f"nodes {[r['id'] for r in wrong]} are not among 0 .. {n - 1}")
    return nodes


def node_lookup(spark: SparkSession, path: str, names: DataFrame) -> DataFrame:
    """(name, id) of a tab- or comma-separated file of (name, id) lines, for names (name)."""
    p = F.split("value", r"\s*,\s*" if file_kind(path) == "csv" else r"\t")
    return spark.read.text(path).select(p[0].alias("name"), p[1].cast("long").alias("id")).join(names, "name", "left_semi")


#: Datasets by name: how their edge lists are to be read.
CATALOGUE = {
    "directed": {"directed": True, "weighted": False, "one_based": True},
    "undirected": {"directed": False, "weighted": False, "one_based": True},
    "weighted": {"directed": True, "weighted": True, "one_based": True},
}


def dataset(spark: SparkSession, path: str, kind: str, largest: bool = False, **changed) -> Graph:
    """A local edge list (one-based ids, repeated pairs added up) read as its kind says; with
    largest, its largest component alone."""
    from lantern.operators.components import largest_component

    g = graph(spark, path, **{**CATALOGUE[kind], **changed})
    return largest_component(g) if largest else g


def alignment(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """(g2_node, g1_node) below a line '%n1::n2', and both numbers."""
    lines = spark.read.text(path)
    m = re.match(r"\s*[%#]\s*(\d+)::(\d+)", lines.first()["value"])
    if not m:
        raise ValueError(f"{path}: no line %n1::n2")
    p = F.split("value", r"\s*,\s*")
    pairs = lines.filter(~F.col("value").rlike(r"^\s*([%#]|$)")).select(p[0].cast("long").alias("g2_node"), p[1].cast("long").alias("g1_node"))
    return pairs, int(m[1]), int(m[2])


def mail_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): all files below a folder of mail, read as Latin-1."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.decode("content", "ISO-8859-1").alias("text"))


def results(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Records of several JSON files, one below the other, with the files' names."""
    out = None
    for name, path in paths.items():
        df = spark.read.json(path, multiLine=True).withColumn("source", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
