"""Writers: what they write, the readers read back."""

from __future__ import annotations

import hashlib
import json
import time

from pyspark.sql import DataFrame, functions as F


def embedding(df: DataFrame, path: str) -> None:
    """(node, features array<double>) as Parquet."""
    df.select("node", "features").write.mode("overwrite").parquet(path)


def embedding_text(df: DataFrame, path: str, digits: int = 6) -> None:
    """Lines 'node f1 f2 ...' with rounded features, below '%n k'."""
    n, k = df.agg(F.count(F.lit(1)), F.max(F.size("features"))).first()
    rounded = F.transform("features", lambda x: F.bround(x, digits).cast("string"))
    body = df.select(F.col("node").alias("o"), F.concat_ws(" ", F.col("node").cast("string"), F.array_join(rounded, " ")).alias("value"))
    head = df.sparkSession.createDataFrame([(-1, f"%{n} {k or 0}")], "o long, value string")
    head.unionByName(body).orderBy("o").select("value").write.mode("overwrite").text(path)


def edges(df: DataFrame, path: str, n: int) -> None:
    """Tab-separated edges below '%n'."""
    columns = [c for c in ("src", "dst", "weight") if c in df.columns]
    body = df.select(F.lit(1).alias("o"), F.concat_ws("\t", *[F.col(c).cast("string") for c in columns]).alias("value"))
    head = df.sparkSession.createDataFrame([(0, f"%{n}")], "o int, value string")
    head.unionByName(body).orderBy("o").select("value").write.mode("overwrite").text(path)


def alignment(pairs: DataFrame, path: str, n1: int, n2: int) -> None:
    body = pairs.select(F.lit(1).alias("o"), F.concat_ws(",", "g2_node", "g1_node").alias("value"))
    head = pairs.sparkSession.createDataFrame([(0, f"%{n1}::{n2}")], "o int, value string")
    head.unionByName(body).orderBy("o").select("value").write.mode("overwrite").text(path)


def labels(df: DataFrame, path: str) -> None:
    """One JSON object {"node": "label"} per line of a node, readable line by line."""
    df.select(F.to_json(F.create_map(F.col("node").cast("string"), F.col("label"))).alias("value")).write.mode("overwrite").text(path)


def results(df: DataFrame, path: str, mode: str = "append") -> None:
    """Result records, added to what is there or ('overwrite') in its place."""
    df.write.mode(mode).json(path)


def replay(path: str, size: int, weights: bool, tol: float, masks: dict[int, list[bool]]) -> None:
    """Parameters of role features and the columns kept at each step, as JSON."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"max_emb_size": size, "use_weights": weights, "prune_tol": tol, "columns2keep": {str(k): v for k, v in masks.items()}}, f)


def read_replay(path: str) -> dict:
    """size, weights, tol and masks, as roles.role_features() takes them."""
    with open(path, encoding="utf-8") as f:
        x = json.load(f)
    return {"size": x["max_emb_size"], "tol": x["prune_tol"], "weights": x["use_weights"], "masks": {int(k): v for k, v in x["columns2keep"].items()}}


def parameter_name(prefix: str, parameters: dict | None = None, stamp: bool = False) -> str:
    """Output name with a hash of the parameters and, on request, the time in ms."""
    out = prefix
    if stamp:
        out += f"_time{int(time.time() * 1000)}"
    if parameters is not None:
        out += "_param" + hashlib.md5(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()
    return out
