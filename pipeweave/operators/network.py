"""Noding, reachability and sizes of pipe networks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipeweave.functions import geo
from pipeweave.storage import Scratch
from pipeweave.operators.cells import near_join
from pipeweave.operators.restrict import S, boxed

T = ("cx", "cy", "dx", "dy")


def intersections(lines: DataFrame, cell: float = 128.0) -> DataFrame:
    """Points where two segments cut each other, parallel ones left out: a and b are places (ordinal, seq) with a < b."""
    one = boxed(lines.select(F.struct("ordinal", "seq").alias("a"), *S))
    two = boxed(lines.select(F.struct("ordinal", "seq").alias("b"), *[F.col(o).alias(n) for o, n in zip(S, T, strict=True)]), T).withColumnsRenamed({"_x0": "_u0", "_y0": "_v0", "_x1": "_u1", "_y1": "_v1"})
    pairs = near_join(one, two, ("_x0", "_y0", "_x1", "_y1"), ("_u0", "_v0", "_u1", "_v1"), 0.0, cell).where("a < b")
    at = pairs.withColumns({"s": F.expr(geo.meets_at(S, T)), "t": F.expr(geo.meets_at(T, S))})
    hit = at.where("s BETWEEN -1e-5 AND 1 + 1e-5 AND t BETWEEN -1e-5 AND 1 + 1e-5")
    return hit.select("a", "b", "s", "t", F.expr("ax + s * (ex - ax)").alias("x"), F.expr("ay + s * (ey - ay)").alias("y"))


def noded(lines: DataFrame, cell: float = 128.0) -> DataFrame:
    """Segments split at all intersections; what two segments share is one edge. Ends are rounded to 1e-4 m."""
    hits = intersections(lines, cell)
    cuts = hits.select("a.ordinal", "a.seq", F.col("s").alias("at")).unionByName(hits.select("b.ordinal", "b.seq", F.col("t").alias("at")))
    ends = lines.select("ordinal", "seq", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("at"))
    places = cuts.select("ordinal", "seq", F.expr("least(1.0, greatest(0.0, at))").alias("at")).unionByName(ends)
    points = places.join(lines.select("ordinal", "seq", *S), ["ordinal", "seq"]).select(
        "ordinal", "seq", "at", F.expr("cast(floor((ax + at * (ex - ax)) * 10000 + 0.5) as bigint)").alias("px"), F.expr("cast(floor((ay + at * (ey - ay)) * 10000 + 0.5) as bigint)").alias("py")
    )
    w = Window.partitionBy("ordinal", "seq").orderBy("at", "px", "py")
    steps = points.withColumns({"qx": F.lead("px").over(w), "qy": F.lead("py").over(w)}).where("qx is not null and (px <> qx or py <> qy)")
    ordered = steps.select("ordinal", F.expr("least(struct(px AS x, py AS y), struct(qx AS x, qy AS y))").alias("u"), F.expr("greatest(struct(px AS x, py AS y), struct(qx AS x, qy AS y))").alias("v"))
    edges = ordered.groupBy("u", "v").agg(F.count_distinct("ordinal").alias("lines"))
    return edges.select(F.col("u.x").alias("ux"), F.col("u.y").alias("uy"), F.col("v.x").alias("vx"), F.col("v.y").alias("vy"), "lines")


def degrees_of(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("ux").alias("x"), F.col("uy").alias("y")).unionByName(edges.select(F.col("vx").alias("x"), F.col("vy").alias("y")))
    return both.groupBy("x", "y").agg(F.count(F.lit(1)).alias("degree"))


def paths_up(edges: DataFrame, root: str) -> DataFrame:
    """node, above, depth: every node with each node on its way to the root, itself included.

    edges: node, parent. The way doubles each round (pointer jumping), so rounds grow with the logarithm
    of the depth, and end when no jump is left. Ways longer than there are nodes are a cycle, an error.
    Each round is written, so that the next does not compute it again. Joins hash the steps, one a node, where they are: no round sends its table through the driver.
    """
    scratch, nodes = Scratch(edges.sparkSession, "paths"), edges.select("node").distinct().count()
    steps = [scratch.keep(edges.select("node", F.col("parent").alias("jump")).where(F.col("parent") != root), "step")]
    while not steps[-1].isEmpty():
        if 2 ** (len(steps) - 1) > nodes:
            raise ValueError("the edges have a cycle: some nodes never come to the root")
        again = steps[-1].withColumnsRenamed({"node": "_m", "jump": "_to"})
        steps.append(scratch.keep(steps[-1].join(again.hint("shuffle_hash"), F.col("jump") == F.col("_m")).select("node", F.col("_to").alias("jump")), "step"))
    out = edges.select("node", F.col("node").alias("above"), F.lit(0).cast("bigint").alias("depth"))
    for i, step in enumerate(steps[:-1]):
        more = out.join(step.withColumnRenamed("node", "_n").hint("shuffle_hash"), F.col("above") == F.col("_n")).select("node", F.col("jump").alias("above"), (F.col("depth") + 2**i).alias("depth"))
        out = scratch.keep(out.unionByName(more), "paths")
    return out


def chains(edges: DataFrame) -> DataFrame:
    """node, parent, head, rank: runs of nodes without branches, numbered from the topmost, their head, on.

    edges: node, parent; a parent that is no node is a root. Pointers double each round, so rounds grow with the logarithm
    of the longest run. Nodes still on their way have pointers of their own, as they are at different places of their run, so no key
    of the join is hot. Nodes of a cycle without branches have no head and no row.
    """
    scratch, only = Scratch(edges.sparkSession, "chains"), ["node", "ptr", "rank", "done"]
    few = edges.groupBy("parent").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").join(edges.select(F.col("node").alias("parent")), "parent", "left_semi")
    inner = edges.join(few, "parent", "left")
    state = scratch.keep(
        inner.select("node", F.when(F.col("_n") == 1, F.col("parent")).otherwise(F.col("node")).alias("ptr"), F.when(F.col("_n") == 1, 1).otherwise(0).cast("long").alias("rank"), F.col("_n").isNull().alias("done")), "state"
    )
    rounds, most = 0, max(1, state.count()).bit_length() + 1
    while not state.where("not done").isEmpty():
        if rounds > most:
            state = state.where("done")
            break
        to = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("_to"), F.col("rank").alias("_more"), F.col("done").alias("_end"))
        moved = state.where("not done").join(to, "ptr").select("node", F.col("_to").alias("ptr"), (F.col("rank") + F.col("_more")).alias("rank"), F.col("_end").alias("done"))
        state, rounds = scratch.keep(state.where("done").select(*only).unionByName(moved), "state"), rounds + 1
    return edges.join(state.select("node", F.col("ptr").alias("head"), "rank"), "node")


def fold_up(edges: DataFrame, how: dict[str, str]) -> DataFrame:
    """node and, for each column of how ("sum" or "max"), the fold over the node and all below it.

    edges: node, parent and the columns; a parent that is no node is a root. Each round takes off all runs that end in a leaf, whose
    folds pointer doubling gives, and adds them to the nodes that they hang on: what was a branching with runs below is then the
    end of a run, so the leaves at least halve. Rounds grow with the logarithms of the leaves and of the longest run, rows with the nodes
    alone. A cycle is an error. Nulls count as nothing.
    """
    scratch, values = Scratch(edges.sparkSession, "fold"), list(how)
    both = lambda c, a, b: F.coalesce(F.col(a) + F.col(b), a, b) if how[c] == "sum" else F.greatest(a, b)
    over = lambda c: (F.sum if how[c] == "sum" else F.max)(c).alias(c)
    alive, found = scratch.keep(edges.select("node", "parent", *values), "alive"), []
    most = max(1, alive.count()).bit_length() + 1
    while not alive.isEmpty():
        below = alive.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("_n"), F.min("node").alias("ptr"))
        kind = F.when(F.col("_n").isNull(), "done").when(F.col("_n") == 1, "moving").otherwise("stuck")
        state = scratch.keep(alive.join(below, "node", "left").select("node", "ptr", kind.alias("kind"), *values), "state")
        rounds = 0
        while not state.where("kind = 'moving'").isEmpty():
            if rounds > most:
                raise ValueError("the edges have a cycle: some nodes never come to a root")
            to = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("kind").alias("_kind"), *[F.col(c).alias(f"_{c}") for c in values])
            moved = state.where("kind = 'moving'").drop("kind").join(to, "ptr").select("node", F.col("_ptr").alias("ptr"), F.col("_kind").alias("kind"), *[both(c, c, f"_{c}").alias(c) for c in values])
            state, rounds = scratch.keep(state.where("kind <> 'moving'").unionByName(moved), "state"), rounds + 1
        done = scratch.keep(state.where("kind = 'done'").join(alive.select("node", "parent"), "node").select("node", "parent", *values), "done")
        if done.isEmpty():
            raise ValueError("the edges have a cycle: some nodes never come to a root")
        found.append(done.select("node", *values))
        rest = alive.join(done.select("node"), "node", "left_anti")
        # Tops of runs only: what hangs on a node that is itself done is in its fold already.
        more = done.join(done.select(F.col("node").alias("parent")), "parent", "left_anti").groupBy(F.col("parent").alias("node")).agg(*[over(c) for c in values])
        more = more.withColumnsRenamed({c: f"_{c}" for c in values})
        alive = scratch.keep(rest.join(more, "node", "left").select("node", "parent", *[both(c, c, f"_{c}").alias(c) for c in values]), "alive")
    return reduce(DataFrame.unionByName, found, edges.select("node", *values).limit(0))


def subtree_flow(edges: DataFrame, root: str = "root") -> DataFrame:
    """The flow of each edge: its own and that of all nodes below."""
    return fold_up(edges.select("node", "parent", "flow", F.lit(1).cast("long").alias("nodes")), {"flow": "sum", "nodes": "sum"})


def minimum_dn(rows: DataFrame, dn_rows: DataFrame) -> DataFrame:
    """rows (flow, length_m) with the smallest DN that carries the flow over the length, null if none does."""
    keyed = rows.withColumn("_id", F.struct(*rows.columns))
    fits = keyed.join(F.broadcast(dn_rows.select("dn", "capacity", "max_length")), F.expr("flow <= capacity + 1e-9 AND length_m <= max_length + 1e-6"), "left")  # 18 rows
    return fits.groupBy("_id").agg(F.min("dn").alias("dn")).select("_id.*", "dn")


def monotone_dn(edges: DataFrame, sized: DataFrame, root: str = "root") -> DataFrame:
    """DN of each edge raised to the greatest of the edges below it."""
    return fold_up(edges.select("node", "parent").join(sized.select("node", "dn"), "node", "left"), {"dn": "max"})


def runs(rows: DataFrame, key: str, order: str, value: str, length: str) -> DataFrame:
    """Runs of rows in a row with an equal value: first and last place, total length, greatest flow."""
    w = Window.partitionBy(key).orderBy(order)
    new = F.when(F.col(value) == F.lag(value).over(w), 0).otherwise(1)
    run = rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(key, "run", value).agg(F.min(order).alias("first_at"), F.max(order).alias("last_at"), F.sum(length).alias("length_m"), F.max("flow").alias("flow"))
