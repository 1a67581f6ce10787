"""Node positions of all reply networks at once, by force-directed placement.

Connected nodes attract each other, near ones push each other away, and every round moves each node
by a step that shrinks from round to round. Repulsion works on a grid: a node is pushed by the
centres of its own and the eight cells around it, each as strongly as it has nodes. So a round is a
few joins on cells and nodes, linear in nodes and edges, and a thread of any size spreads over all
tasks. Rounds know threads and nodes by numbers, and cells, of which there are fewer than nodes, are
what goes to the cells around them. Positions and forces are added as whole numbers, so the result does not depend
on the order of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlab.session import discard, materialise

UNIT = 1 << 30  # one side of the starting square, in whole numbers
ROUNDS = 50
STEP = 0.1  # of the square, that a node moves in the first round
NEAR = 0.01  # distances and forces below it count as it
KEY = ["post_id", "node"]


def _start(seed: int, axis: str) -> Column:
    """A place in the starting square, from the name of the node."""
    name = F.concat_ws(":", F.lit(str(seed)), "post_id", "node", F.lit(axis))
    return F.shiftright(F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long"), 2)


def _whole(value: Column) -> Column:
    return F.floor(value * F.lit(float(UNIT)) + F.lit(0.5)).cast("long")


def _cell(at: str) -> Column:
    """Number of the cell: its side is twice the ideal distance 1 / sqrt(nodes)."""
    side = f"cast(floor({2.0 * UNIT}D / sqrt(cast(n as double))) as long)"
    return F.expr(f"({at} - pmod({at}, {side})) div {side}")


def _size(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def network_nodes(edges: DataFrame) -> DataFrame:
    """(post_id, node): everyone with an edge; a self-reply is one."""
    return edges.select("post_id", F.explode(F.array("source", "target")).alias("node")).where("node is not null").distinct()


def _forces(state: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, fx, fy): what pushes and pulls each node, in whole numbers."""
    ideal = F.lit(1.0) / F.sqrt(F.col("n").cast("double"))
    placed = state.withColumns({"cx": _cell("x"), "cy": _cell("y")})
    cells = placed.groupBy("thread", "cx", "cy").agg(F.count(F.lit(1)).alias("m"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    around = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    seen_by = F.explode(F.array(*[
        F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy"), F.lit(int(i == j == 0)).cast("long").alias("own"))
        for i, j in around
    ]))
    near = cells.select("thread", seen_by.alias("c"), "m", "sx", "sy").select("thread", "c.*", "m", "sx", "sy")
    others = F.col("m") - F.col("own")
    x = (F.col("x") - (F.col("sx") - F.col("own") * F.col("x")).cast("double") / others) / F.lit(float(UNIT))
    y = (F.col("y") - (F.col("sy") - F.col("own") * F.col("y")).cast("double") / others) / F.lit(float(UNIT))
    push = others.cast("double") * ideal * ideal
    pushed = (
        placed.join(near.hint("merge"), ["thread", "cx", "cy"]).where(others > 0)
        .select("id", x.alias("dx"), y.alias("dy"), push.alias("push"))
        .withColumn("d", F.greatest(_size(F.col("dx"), F.col("dy")), F.lit(NEAR)))
        .select("id", *[_whole(F.col(c) * F.col("push") / (F.col("d") * F.col("d"))).alias(f) for c, f in (("dx", "fx"), ("dy", "fy"))])
        # Added up where they meet: a node is in one cell, so that one row of it travels, not nine.
        .groupBy("id").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
    )

    def end(name: str) -> DataFrame:
        size = ["n"] if name == "a" else []
        return state.select(F.col("id").alias(name), F.col("x").alias(f"{name}x"), F.col("y").alias(f"{name}y"), *size)

    met = pairs.join(end("a").hint("merge"), "a").join(end("b").hint("merge"), "b")
    apart = met.select(
        "a", "b", "n",
        ((F.col("ax") - F.col("bx")).cast("double") / F.lit(float(UNIT))).alias("dx"),
        ((F.col("ay") - F.col("by")).cast("double") / F.lit(float(UNIT))).alias("dy"),
    ).withColumn("pull", F.greatest(_size(F.col("dx"), F.col("dy")), F.lit(NEAR)) / ideal)
    ends = F.explode(F.array(*[
        F.struct(
            F.col(name).alias("id"), _whole(F.col("dx") * F.col("pull") * sign).alias("fx"), _whole(F.col("dy") * F.col("pull") * sign).alias("fy")
        )
        for name, sign in (("a", F.lit(-1.0)), ("b", F.lit(1.0)))
    ]))
    pulled = apart.select(ends.alias("e")).select("e.*")
    return pushed.unionByName(pulled).groupBy("id").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))


def network_layout(edges: DataFrame, rounds: int = ROUNDS, seed: int = 42) -> DataFrame:
    """(post_id, node, x, y) for everyone in the reply network of a thread.

    The centre of a thread's nodes is (0, 0) and its largest coordinate is 1. Self-replies and
    parallel edges pull no more than one edge or none, ends without a name are left out; a thread of
    one node has it at (0, 0). The same edges and ``seed`` give the same positions, however the rows lie.
    """
    # A missing end is passed over by least and greatest: such an edge is a node, as a self-reply is.
    ends = materialise(
        edges.select("post_id", F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"))
        .where("source is not null").distinct(),
        "pairs",
    )
    nodes = materialise(network_nodes(ends), "nodes")
    sizes = materialise(
        nodes.groupBy("post_id").agg(F.count(F.lit(1)).alias("n")).withColumn("thread", F.monotonically_increasing_id()), "sizes"
    )
    names = materialise(nodes.join(sizes, "post_id").withColumn("id", F.monotonically_increasing_id()), "names")
    number = {c: names.select("post_id", F.col("node").alias(c), F.col("id").alias(i)) for c, i in (("source", "a"), ("target", "b"))}
    pairs = materialise(
        ends.where("source <> target").join(number["source"], ["post_id", "source"]).join(number["target"], ["post_id", "target"]).select("a", "b"),
        "pairs",
    )
    state = materialise(names.select("id", "thread", _start(seed, "x").alias("x"), _start(seed, "y").alias("y"), "n"), "positions")
    for table in (ends, nodes, sizes):
        discard(table)
    for r in range(rounds):
        step = F.lit(STEP * (1 - r / (rounds + 1)))
        fx, fy = (F.coalesce(c, F.lit(0)).cast("double") / F.lit(float(UNIT)) for c in ("fx", "fy"))
        length = _size(F.col("px"), F.col("py"))
        share = step / F.when(length < NEAR, F.lit(0.1)).otherwise(length)
        moved = (
            state.join(_forces(state, pairs).hint("merge"), "id", "left").withColumns({"px": fx, "py": fy})
            .select("id", "thread", (F.col("x") + _whole(F.col("px") * share)).alias("x"), (F.col("y") + _whole(F.col("py") * share)).alias("y"), "n")
        )
        before, state = state, materialise(moved, "positions")
        discard(before)
    discard(pairs)
    centre = state.groupBy("thread").agg(
        (F.sum("x").cast("double") / F.count(F.lit(1))).alias("mx"), (F.sum("y").cast("double") / F.count(F.lit(1))).alias("my"),
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
    )
    far = F.greatest(F.col("x1") - F.col("mx"), F.col("mx") - F.col("x0"), F.col("y1") - F.col("my"), F.col("my") - F.col("y0"))
    named = state.join(names.select("id", *KEY), "id")
    return named.join(centre.select("thread", "mx", "my", far.alias("far")), "thread").select(
        *KEY, *[F.when(F.col("far") > 0, (F.col(c) - F.col(f"m{c}")) / F.col("far")).otherwise(0.0).alias(c) for c in ("x", "y")]
    )
