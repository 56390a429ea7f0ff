"""Many sources at once: each row holds a node and the values of LANES sources there.

What starts from many sources - heat, search, path counts - keeps a value for each (source,
node). Sources are dealt into blocks, and the state is (node, block, a column a lane): a step
moves one row of plain numbers for LANES sources, inside generated code, and sums them lane by
lane before and after the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from lantern.session import released, setting, written

LANES = 16
#: Steps between two tables in the shared folder.
CUT = 8
#: Steps of a sum of powers between two such tables where one range holds all nodes; what they
#: shuffle stays until then, so larger graphs write each step.
SUMMED = 2
#: Nodes of a range of ids, whose rows are summed in one place.
RANGE = 2048
#: Ids for each node up to which a range is a run of ids.
SPARSE = 4
#: Sources that one task numbers.
NUMBERED = 4096
#: Sources whose places are broadcast (some 72 bytes each).
FEW = 200_000
#: Sources of a turn at least, and turns at most: the state of one turn is on disk at a time.
TURN, TURNS = 256, 4
#: Lets a join by part and node use what is dealt out by part alone.
TOGETHER = "spark.sql.requireAllClusterKeysForCoPartition"


def numbering(sources: DataFrame, per: int, width: int = 1, turns: int = 1) -> DataFrame:
    """(source, block, lane, turn): distinct ids of sources, `per` in a block at most, each with
    `width` lanes from `lane` on. Written once, so that every reader sees the same places. Turns
    are runs of blocks, up to `turns` of them, each of TURN sources or more.

    Blocks are runs of ids in order: a state has a row for each node that any source of a block
    reaches, so sources that reach the same nodes (as ids of one part of the graph do) belong
    in one block. Dealt out by hash, the rows grow with nodes x blocks."""
    s = written(sources.select(F.col("id").alias("source")).distinct(), "distinct")
    n = s.count()
    turns = max(1, min(turns, n // TURN))
    parts = max(turns, -(-n // NUMBERED))
    s = written(s.repartitionByRange(parts, "source").sortWithinPartitions("source").withColumn("m", F.monotonically_increasing_id()), "sources")
    place = F.col("m").bitwiseAND(F.lit((1 << 33) - 1)) % per
    turn = F.floor(F.shiftright("m", 33) * turns / parts).cast("int")
    out = s.select("source", (F.col("m") - place).alias("block"), (place * width).cast("int").alias("lane"), turn.alias("turn"))
    out = F.broadcast(out) if n <= FEW else out
    out._turns = turns
    return out


def named(prefix: str, n: int = LANES) -> list[str]:
    return [f"{prefix}{j}" for j in range(n)]


def lane_values(value: Callable[[int], float], width: int, prefix: str = "x") -> list[Column]:
    """LANES columns: value(t) in the t-th lane from `lane` on, else 0."""
    lane = lambda j: sum((F.when(F.col("lane") == j - t, F.lit(float(value(t)))).otherwise(F.lit(0.0)) for t in range(width)), F.lit(0.0))
    return [lane(j).alias(f"{prefix}{j}") for j in range(LANES)]


def started(places: DataFrame, value: Callable[[int], float], width: int, prefix: str = "x") -> DataFrame:
    """(node, block, lanes): at each source's own node value(t) in its t-th lane."""
    return places.select(F.col("source").alias("node"), "block", *lane_values(value, width, prefix))


def listed(state: DataFrame, places: DataFrame, width: int, prefix: str = "x") -> DataFrame:
    """(source, node, t, value): the lanes that aren't 0, a row each."""
    parts = F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"{prefix}{j}").alias("value")) for j in range(LANES)])
    rows = state.select("node", "block", F.explode(parts).alias("p")).select("node", "block", "p.j", "p.value").filter("value <> 0")
    rows = rows.withColumn("t", F.col("j") % width).withColumn("lane", F.col("j") - F.col("j") % width)
    return rows.join(places, ["block", "lane"]).select("source", "node", "t", "value")


def moves(entries: DataFrame, nodes: DataFrame, *names: str) -> DataFrame:
    """(_s, dst, names, keep): the entries of a step, and for each node a row that keeps what
    it has. One join with it makes both, so a state is read once and plans grow by the step."""
    stay = nodes.select(F.col("id").alias("_s"), F.col("id").alias("dst"), *[F.lit(0.0).alias(n) for n in names], F.lit(True).alias("keep"))
    return written(entries.withColumn("keep", F.lit(False)).unionByName(stay), "moves")


def ranges(nodes: DataFrame, size: int | None = None) -> DataFrame:
    """(id, part): nodes in ranges of ids of about `size`, by default RANGE. Where ids lie close,
    a range is a run of `size` ids and its number is arithmetic, so that no table of nodes is
    joined; elsewhere ranges are drawn from the ids."""
    size = size or RANGE
    n, least, most = nodes.agg(F.count("id"), F.min("id"), F.max("id")).first()
    if n and most - least < SPARSE * n:
        out = nodes.select("id")
        out._runs, out._parts = (least, size, (most - least) // size), (most - least) // size + 1
        return placed(out, out, "id")
    parts = max(1, -(-n // size))
    out = written(nodes.select("id").repartitionByRange(parts, "id").select("id", F.spark_partition_id().alias("part")), "ranges")
    out._parts = parts
    return out


def placed(rows: DataFrame, where: DataFrame, node: str = "node") -> DataFrame:
    """rows with the part of their node; one that is no node of the graph lies in some part."""
    if hasattr(where, "_runs"):
        least, size, last = where._runs
        part = F.expr(f"CAST(least({last}, greatest(0, (`{node}` - ({least})) div {size})) AS INT)")
        out = rows.withColumn("part", F.coalesce(part, F.lit(0)))
        if rows is where:
            out._runs, out._parts = where._runs, where._parts
        return out
    return rows.join(where.withColumnRenamed("id", "_id"), F.col(node) == F.col("_id"), "left").drop("_id").withColumn("part", F.coalesce("part", F.lit(0)))


def dealt(entries: DataFrame, where: DataFrame, *names: str) -> DataFrame:
    """(_s, part, to, names): the entries (_s, dst, names) of a step, a row for each part that a
    node's entries lead to, with lists of them. What a node has goes once to each such part and
    is multiplied and summed there (`met`): moved are rows x parts, and not rows x edges."""
    rows = placed(entries, where, "dst").groupBy("_s", "part")
    return written(rows.agg(F.collect_list("dst").alias("to"), *[F.collect_list(n).alias(n) for n in names]), "dealt")


def heads(lists: DataFrame, where: DataFrame) -> DataFrame:
    """(part, node, parts): the parts that a node's entries lead to, in its own part."""
    h = lists.groupBy(F.col("_s").alias("node")).agg(F.collect_list("part").alias("parts"))
    return written(placed(h, where), "heads")


def headed(rows: DataFrame, top: DataFrame) -> DataFrame:
    """rows (part, node, ...), lying by part, with the parts that their nodes lead to."""
    return rows.join(top.repartition("part"), ["part", "node"], "left")


def gathered(moving: DataFrame, lists: DataFrame, *names: str) -> DataFrame:
    """moving (part, _s, own, ...) where its part lies, with the lists there: (part, node, names,
    ...), node and names being arrays. Rows that are `own` stay at their node, with 1. Lists
    are moved once, however many rows a node has."""
    both = moving.repartition("part").join(lists.repartition("part"), ["part", "_s"], "left")
    mine = lambda own, other: F.when(F.col("own"), F.array(own)).otherwise(F.col(other))
    rest = [c for c in moving.columns if c not in ("part", "_s")]
    return both.select("part", mine(F.col("_s"), "to").alias("node"), *[mine(F.lit(1.0), n).alias(n) for n in names], *rest)


def met(moving: DataFrame, lists: DataFrame, *names: str) -> DataFrame:
    """gathered(), a row (part, node, names, ...) for each entry: sums by part, node and more
    are then made in the same task (under TOGETHER)."""
    both = gathered(moving, lists, *names)
    rest = [c for c in moving.columns if c not in ("part", "_s", "own")]
    if not names:
        return both.select("part", F.explode("node").alias("node"), *rest)
    return both.select("part", F.inline(F.arrays_zip("node", *names)), *rest)


def together(df: DataFrame, name: str) -> DataFrame:
    """written(), where what lies by part is joined and summed by part and more."""
    with setting(df.sparkSession, TOGETHER, "false"):
        return written(df, name)


def polynomial(steps: DataFrame, sources: DataFrame, weights: list[list[float]], totals: DataFrame | None = None) -> DataFrame:
    """(source, node, t, value): for each list of weights, sum over k of weights[t][k] *
    steps^k e_source, by Horner's rule: the last power is moved, the one before added to it,
    and so on. steps: (src, dst, p); with totals (id, total), p is divided by src's. Lists past
    LANES go in turns, and so do many sources."""
    where = ranges(steps.select(F.explode(F.array("src", "dst")).alias("id")).unionByName(sources.select("id")).distinct())
    moves = dealt(steps.select(F.col("src").alias("_s"), "dst", "p"), where, "p")
    if totals is not None:
        plain = moves
        shares = F.transform("p", lambda p: p / F.col("total"))
        moves = written(plain.join(totals, F.col("_s") == F.col("id")).select("_s", "part", "to", shares.alias("p")), "dealt")
        released(plain)
    top = heads(moves, where)
    cut = SUMMED if where._parts == 1 else 1
    out = None
    for first in range(0, len(weights), LANES):
        lists = weights[first : first + LANES]
        width = len(lists)
        places = numbering(sources, LANES // width, width, TURNS)
        for turn in range(places._turns):
            own = written(placed(places.filter(F.col("turn") == turn), where, "source"), "own")
            begun = lambda k: own.select("part", F.col("source").alias("node"), "block", *lane_values(lambda t: lists[t][k], width))  # noqa: E731, B023
            state, last = begun(len(lists[0]) - 1), None
            for i, k in enumerate(range(len(lists[0]) - 2, -1, -1), 1):
                if i == 1 or cut > 1:
                    state = headed(state, top)
                go = state.select(F.explode("parts").alias("part"), F.col("node").alias("_s"), "block", *named("x"), F.lit(False).alias("own"))
                rows = met(go.unionByName(begun(k).withColumnRenamed("node", "_s").withColumn("own", F.lit(True))), moves, "p")
                state = rows.groupBy("part", "node", "block").agg(*[F.sum(F.col(x) * F.col("p")).alias(x) for x in named("x")])
                if cut == 1 and k:
                    state = headed(state, top)
                if i % cut == 0 or not k:
                    state = together(state, "lanes")
                    if last is not None:
                        released(last)
                    last = state
            rows = listed(state, places, width).withColumn("t", F.col("t") + first)
            out = rows if out is None else out.unionByName(rows)
    released(top, moves)
    return out


def chebyshev(x: DataFrame, nodes: DataFrame, sources: DataFrame, weights: list[list[float]]) -> DataFrame:
    """(source, node, t, value): sum over k of weights[t][k] * T_k(x) e_source, by Clenshaw's
    recurrence from the last term on. x: (row, col, value)."""
    x = moves(x.select(F.col("col").alias("_s"), F.col("row").alias("dst"), "value"), nodes, "value")
    out = None
    for first in range(0, len(weights), LANES):
        lists = weights[first : first + LANES]
        width = len(lists)
        places = numbering(sources, LANES // width, width)
        at = lambda k: started(places, lambda t: lists[t][k], width).select("node", "block", *named("x"), *[F.lit(0.0).alias(o) for o in named("o")])  # noqa: E731, B023
        state = at(len(lists[0]) - 1)
        for i, k in enumerate(range(len(lists[0]) - 2, -1, -1), 1):
            twice = F.lit(2.0 if k else 1.0)
            both = state.join(x, F.col("node") == F.col("_s"))
            value = lambda j: F.when(F.col("keep"), -F.col(f"o{j}")).otherwise(twice * F.col(f"x{j}") * F.col("value")).alias(f"x{j}")  # noqa: E731, B023
            old = lambda j: F.when(F.col("keep"), F.col(f"x{j}")).otherwise(F.lit(0.0)).alias(f"o{j}")
            moved = both.select(F.col("dst").alias("node"), "block", *map(value, range(LANES)), *map(old, range(LANES)))
            state = moved.unionByName(at(k)).groupBy("node", "block").agg(*[F.sum(c).alias(c) for c in named("x") + named("o")])
            if i % CUT == 0:
                state = written(state, "lanes")
        rows = listed(state, places, width).withColumn("t", F.col("t") + first)
        out = rows if out is None else out.unionByName(rows)
    return out


#: Sources in a word of a bit set, and words of a row.
BITS, WORDS = 64, 4


def bit(lane: Column, word: int) -> Column:
    """The word's bits for a source in this lane."""
    return F.when(F.floor(lane / BITS) == word, F.call_function("shiftleft", F.lit(1).cast("long"), (lane % BITS).cast("int"))).otherwise(F.lit(0).cast("long"))


def any_of(names: list[str]) -> Column:
    out = F.col(names[0]) != 0
    for n in names[1:]:
        out = out | (F.col(n) != 0)
    return out


def set_bits(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows with a column lane, a row for each bit that is set in the words."""
    def lanes(i: int, name: str) -> Column:
        on = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.getbit(F.col(name), b) == 1)
        return F.transform(on, lambda b: b + i * BITS)

    return rows.withColumn("lane", F.explode(F.concat(*[lanes(i, n) for i, n in enumerate(names)])))
