"""Command line: embeddings of a graph file.

python -m lantern heat --input graph.edgelist --output out --size 128 --radius 3"""

from __future__ import annotations

import argparse
import sys

from lantern.experiments import EMBEDDINGS
from lantern.session import get_session
from lantern.sources import edges, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lantern", description=__doc__)
    p.add_argument("embedding", choices=sorted(EMBEDDINGS))
    p.add_argument("--input", required=True, help="edge list: tsv, csv, edgelist or Parquet")
    p.add_argument("--output", required=True, help="folder of Parquet (node, features)")
    p.add_argument("--text", action="store_true", help="write lines of text in place of Parquet")
    p.add_argument("--nodes", help="a file of node ids, one a line: the nodes wanted")
    p.add_argument("--undirected", action="store_true")
    p.add_argument("--weighted", action="store_true")
    p.add_argument("--include-time", action="store_true", help="put the time into the output's name")
    p.add_argument("--include-hash", action="store_true", help="put a hash of the parameters into the output's name")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--size", type=int, default=128)
    for name, kind in (("radius", int), ("order", int), ("tol", float), ("alpha", float), ("gamma", float)):
        p.add_argument(f"--{name}", type=kind)
    for name in ("transpose", "aggregate", "normalise"):
        p.add_argument(f"--{name}", action="store_true")
    p.add_argument("--linear", action="store_true", help="the linear angle in place of the logarithmic one")
    p.add_argument("--replay", help="recursive: a spec of an earlier run to follow")
    p.add_argument("--save-replay", help="recursive: where to put this run's spec")
    return p


def parameters(a: argparse.Namespace) -> dict:
    """Options of the embedding, those not given left to its own defaults."""
    out = {k: getattr(a, k) for k in ("radius", "order", "tol", "alpha", "gamma") if getattr(a, k) is not None}
    if a.embedding == "heat":
        out |= {k: getattr(a, k) for k in ("transpose", "aggregate", "normalise")} | {"log": not a.linear}
        out = {k: v for k, v in out.items() if k not in ("tol", "alpha", "gamma")}
    if a.embedding in ("heat", "landmark"):
        out["undirected"] = a.undirected
    return out


def main(argv: list[str] | None = None) -> str:
    a = parser().parse_args(argv)
    spark = get_session("lantern")
    g = edges.graph(spark, a.input, not a.undirected, a.weighted)
    options = parameters(a)
    if a.nodes:
        wanted = spark.read.text(a.nodes).selectExpr("cast(trim(value) AS long) AS id").filter("id IS NOT NULL")
        options["selected"] = edges.selected(wanted, g.nodes.count())
    if a.embedding == "recursive" and (a.replay or a.save_replay):
        from lantern.experiments import wide
        from lantern.operators.roles import role_features

        spec = sinks.read_replay(a.replay) if a.replay else {"size": a.size, "tol": options.get("tol", 1e-6), "weights": a.weighted, "masks": None}
        long, masks = role_features(g, spec["size"], spec["tol"], spec["weights"], spec["masks"])
        if a.save_replay:
            sinks.replay(a.save_replay, spec["size"], spec["weights"], spec["tol"], masks)
        out = wide(long)
    else:
        out = EMBEDDINGS[a.embedding](g, a.size, **options, **({"weights": a.weighted} if a.embedding == "recursive" else {}))
    hashed = {k: v for k, v in vars(a).items() if k not in ("input", "output", "verbose", "include_time", "include_hash")} if a.include_hash else None
    path = sinks.parameter_name(a.output, hashed, a.include_time)
    (sinks.embedding_text if a.text else sinks.embedding)(out, path)
    if a.verbose:
        print(f"{a.embedding}: {path}", file=sys.stderr)
    return path


if __name__ == "__main__":
    main()
