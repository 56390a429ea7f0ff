"""Graph generators as arithmetic on ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lantern.graph import before, in_order, reindex
from lantern.session import written


def cycle(spark: SparkSession, n: int, chords: list[tuple[int, int]] = ()) -> DataFrame:
    """(src, dst): i -> i + 1 around n nodes, and the chords given."""
    e = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    return e.unionByName(spark.createDataFrame(list(chords), "src long, dst long")) if chords else e


def diameter_chords(n: int, k: int) -> list[tuple[int, int]]:
    """k chords across a cycle of n nodes, evenly placed."""
    return [(i * n // (2 * k), (i * n // (2 * k) + n // 2) % n) for i in range(k)]


def diamond(spark: SparkSession, n: int) -> DataFrame:
    """0 -> each of 1 .. n-2 -> n-1."""
    mid = spark.range(1, n - 1)
    return mid.select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst")).unionByName(mid.select(F.col("id").alias("src"), F.lit(n - 1).cast("long").alias("dst")))


def star_size(arms: int, branch: int, depth: int) -> int:
    return 1 + arms * sum(branch**i for i in range(depth))


def star(spark: SparkSession, arms: int, branch: int, depth: int) -> DataFrame:
    """(src, dst): a centre with `arms` children, each node down to `depth` with `branch`;
    nodes are numbered level by level, so a parent follows from the number."""
    out = spark.range(1, arms + 1).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    start, size = 1, arms
    for _ in range(1, depth):
        child = spark.range(size * branch)
        out = out.unionByName(child.select((F.lit(start) + F.floor(F.col("id") / branch)).alias("src"), (F.lit(start + size) + F.col("id")).alias("dst")))
        start, size = start + size, size * branch
    return out


def random_chords(n: int, k: int, seed: int = 0) -> list[tuple[int, int]]:
    """k chords of a cycle of n nodes between random nodes that are not neighbours."""
    import random

    rng, out = random.Random(seed), set()
    while len(out) < min(k, n * (n - 3)):
        a, b = rng.randrange(n), rng.randrange(n)
        if (b - a) % n not in (0, 1, n - 1):
            out.add((a, b))
    return sorted(out)


def both(e: set[tuple[int, int]]) -> set[tuple[int, int]]:
    return e | {(b, a) for a, b in e}


def clique(nodes: range) -> set[tuple[int, int]]:
    return {(a, b) for a in nodes for b in nodes if a != b}


def round_(nodes: range) -> set[tuple[int, int]]:
    return {(a, nodes[(i + 1) % len(nodes)]) for i, a in enumerate(nodes)}


def turned(e: set[tuple[int, int]], on: bool) -> set[tuple[int, int]]:
    return {(b, a) for a, b in e} if on else e


def motif(name: str, reverse: bool = False) -> tuple[list[tuple[int, int]], list[int]]:
    """Edges of a motif, or of its counterpart, and the role of each of its nodes; nodes of one
    role can be exchanged. L: a clique with a tail; C: a ring with two chords; B: two cliques
    joined by two paths that end in one node, one edge twice; DB: two cliques joined; S: a star; DS:
    two two-way stars joined; D: a hub's five paths to a sink; PB: two two-way rings with chords
    joined both ways; W: two wheels joined both ways; U, H: two small graphs given by their edges."""
    hub = lambda c, leaves: {(c, i) for i in leaves}
    path = lambda a, b: {(i, i + 1) for i in range(a, b)}
    twice: set[tuple[int, int]] = set()
    if name == "L5":
        e, roles = turned(clique(range(5)) | path(4, 9), reverse), [0, 0, 0, 0, 1, 2, 3, 4, 5, 6]
    elif name == "C8":
        e, roles = turned(round_(range(8)), reverse) | {(0, 5), (6, 3)}, list(range(8))
    elif name == "B5":
        left = clique(range(5)) | path(3, 7) | {(8, 7), (9, 8)}
        e, roles = turned(left | clique(range(10, 15)) | {(10, 9)}, reverse), [0, 0, 0, 0, 1, 2, 3, 4, 3, 2, 1, 0, 0, 0, 0]
        twice = turned({(3, 4)}, reverse)
    elif name == "DB55":
        e = clique(range(5)) | clique(range(5, 10)) | {(4, 5)} | ({(5, 4)} if reverse else set())
        roles = [0, 0, 0, 0, 1, 1, 0, 0, 0, 0] if reverse else [0, 0, 0, 0, 1, 2, 3, 3, 3, 3]
    elif name == "S5":
        e, roles = turned(hub(0, range(1, 6)), reverse), [0, 1, 1, 1, 1, 1]
    elif name == "DS5":
        e = both(hub(0, range(1, 6)) | hub(6, range(7, 12))) | {(0, 6)} | ({(6, 0)} if reverse else set())
        roles = [1, *[0] * 5, 1, *[0] * 5] if reverse else [1, *[0] * 5, 2, *[3] * 5]
    elif name == "D5":
        e = hub(0, range(1, 6)) | {(i, i + 5) for i in range(1, 6)} | {(i, 11) for i in range(6, 11)}
        e, roles = (both(e), [0, *[1] * 10, 0]) if reverse else (e, [0, *[1] * 5, *[2] * 5, 3])
    elif name == "PB5":
        chords = {(2, 0), (1, 3), (7, 9), (8, 6)}
        e, roles = both(round_(range(5)) | round_(range(5, 10))) | {(4, 5), (5, 4)} | turned(chords, reverse), [0, 1, 1, 0, 2, 2, 0, 1, 1, 0]
    elif name == "W5":
        wheel = lambda c, rim: both(round_(rim)) | hub(c, rim)
        e = wheel(5, range(5)) | turned(wheel(11, range(6, 11)), reverse) | {(0, 7)} | ({(2, 10)} if reverse else {(10, 2)})
        roles = [0, 1, 0, 2, 2, 3, 4, 5, 6, 6, 5, 7] if reverse else [0, 1, 2, 3, 4, 5, 1, 2, 3, 4, 0, 5]
    elif name == "U5":
        e = both(hub(1, range(2, 7))) | {(2, 3), (3, 4), (4, 5), (5, 6)} | {(1, 0) if reverse else (0, 1)}
        roles = list(range(7))
    elif name == "H5":
        # The edges of both forms.
        e = {(0, 1), (0, 2), (1, 2), (1, 3), (1, 4), (2, 1), (2, 3), (2, 4), (3, 1), (3, 4), (4, 2), (4, 3)}
        e, roles = (e if reverse else {(1, 0), (1, 2), (1, 3), (2, 0), (2, 1), (2, 4), (3, 1), (3, 2), (3, 4), (4, 1), (4, 2), (4, 3)}), [0, 1, 1, 2, 2]
    else:
        raise ValueError(f"no motif {name}")
    return sorted([*e, *twice]), roles


MOTIFS = ("B5", "C8", "D5", "DB55", "DS5", "H5", "L5", "PB5", "S5", "U5", "W5")


def ring_of_motifs(spark: SparkSession, motifs: list[str] = MOTIFS, copies: int = 10, gap: int = 5, connectors: int = 0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """((src, dst), (id, role, part)): a two-way ring of `gap` nodes for each motif, beside
    it `copies` of both forms of each motif in a random order, and for each of these
    `connectors` two-way edges between a random node of it and one of its stretch of the ring
    (but for the stretch's last). role: main, or motif_form_role; part: the motif's number, -1
    for the ring."""
    forms = [(name, back) for name in motifs for back in (True, False)]
    shapes = {f: motif(*f) for f in forms}
    total = len(forms) * copies
    ring = max(gap * total, 10)
    # Only the motifs' number is on the driver: which form each is, and where it begins.
    placed = spark.range(total).select((F.col("id") % len(forms)).cast("int").alias("form"), F.xxhash64("id", F.lit(seed)).alias("h"), "id")
    placed = reindex(placed.select(F.struct("h", "id", "form").alias("k")), "k").select("k.form", F.col("index").alias("part"))
    sizes = F.array(*[F.lit(len(shapes[f][1])) for f in forms])
    placed = in_order(placed.withColumn("size", sizes[F.col("form")]), "part")
    inside = F.sum("size").over(Window.partitionBy("_p").orderBy("_i")) - F.col("size")
    placed = placed.withColumn("at", inside).join(F.broadcast(before(placed, F.sum("size"))), "_p")  # a row per range
    placed = written(placed.select("form", "part", "size", (F.lit(ring) + F.col("before") + F.col("at")).alias("base")), "motifs")
    edge = [(i, a, b) for i, f in enumerate(forms) for a, b in shapes[f][0]]
    node = [(i, j, f"{f[0]}_{int(f[1])}_{r}") for i, f in enumerate(forms) for j, r in enumerate(shapes[f][1])]
    edges = placed.join(F.broadcast(spark.createDataFrame(edge, "form int, a long, b long")), "form")  # the motifs' shapes
    nodes = placed.join(F.broadcast(spark.createDataFrame(node, "form int, j long, role string")), "form")
    around = cycle(spark, ring)
    e = around.unionByName(around.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).unionByName(edges.select((F.col("base") + F.col("a")).alias("src"), (F.col("base") + F.col("b")).alias("dst")))
    labels = spark.range(ring).select("id", F.lit("main").alias("role"), F.lit(-1).cast("long").alias("part"))
    labels = labels.unionByName(nodes.select((F.col("base") + F.col("j")).alias("id"), "role", "part"))
    if connectors:
        h = lambda s, n: F.pmod(F.xxhash64("part", "c", F.lit(seed + s)), n)
        c = placed.withColumn("c", F.explode(F.sequence(F.lit(1), F.lit(connectors))))
        c = c.select((F.col("base") + h(1, F.col("size"))).alias("src"), (F.col("part") * gap + h(2, F.lit(max(gap - 1, 1)))).alias("dst")).distinct()
        e = e.unionByName(c).unionByName(c.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return e, labels


def split_parts(labels: DataFrame, n_train: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training, test and other (node, label) of (id, role, part): of each kind of motif the
    first n_train parts, the others, and the ring."""
    kind = F.regexp_replace("role", "_[^_]*$", "")
    x = labels.filter("part >= 0").withColumn("kind", kind)
    each = x.select("kind", "part").distinct()
    nth = F.row_number().over(Window.partitionBy("kind").orderBy("part"))  # a row per motif
    x = written(x.join(each.withColumn("nth", nth), ["kind", "part"]), "parts")
    pick = lambda df: df.select(F.col("id").alias("node"), F.col("role").alias("label"))
    return pick(x.filter(F.col("nth") <= n_train)), pick(x.filter(F.col("nth") > n_train)), pick(labels.filter("part < 0"))


def preferential(spark: SparkSession, n: int, m: int, seed: int = 0) -> DataFrame:
    """(src, dst): node t links to m earlier nodes, each the end of a random earlier link
    (or its start), so that chances grow with degrees. Link j's target is resolved by
    following links to earlier ones, all links a step at a time: the number of steps grows
    with the logarithm of the number of links."""
    links = spark.range(m, n * m).select(F.col("id").alias("j"))
    draw = F.pmod(F.xxhash64("j", F.lit(seed)), 2 * (F.floor(F.col("j") / m) * m).cast("long"))
    # An even draw stands for the start of link draw / 2, an odd one for its end.
    links = written(links.select("j", F.floor(draw / 2).alias("at"), (draw % 2 == 0).alias("start")), "links")
    open_ = links
    done = None
    while True:
        settled = open_.filter(F.col("start") | (F.col("at") < m)).select("j", F.when(F.col("start"), F.floor(F.col("at") / m)).otherwise(0).cast("long").alias("dst"))
        done = settled if done is None else done.unionByName(settled)
        left = open_.filter(~(F.col("start") | (F.col("at") < m)))
        nxt = left.select("j", F.col("at").alias("k")).join(links.select(F.col("j").alias("k"), "at", "start"), "k").select("j", "at", "start")
        open_ = written(nxt, "links")
        if open_.isEmpty():
            break
    e = done.select(F.floor(F.col("j") / m).cast("long").alias("src"), "dst")
    return e.filter("src <> dst").distinct()
