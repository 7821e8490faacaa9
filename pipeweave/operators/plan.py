"""Trees of planned pipes: consumers, components, lengths, kinds of nodes, status and choice of plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipeweave.operators.network import paths_up

ROOT = -1


def consumers(pipes: DataFrame, up: DataFrame) -> DataFrame:
    """node, consumers (number), least, most and flow of the consumers below each pipe, itself included. Pipes are rows of node, parent, flow."""
    some = up.join(pipes.where("flow > 0").select("node", "flow").hint("shuffle_hash"), "node")  # grows with the pipes: never broadcast, however small its columns
    return some.groupBy(F.col("above").alias("node")).agg(F.count_distinct("node").alias("consumers"), F.min("node").alias("least"), F.max("node").alias("most"), F.sum("flow").alias("flow"))


def components(pipes: DataFrame, up: DataFrame) -> DataFrame:
    """head, pipes, length_m, flow: pipes in a row that serve the same consumers. In a tree, sets of consumers of one way are nested, so equal numbers are equal sets."""
    n = consumers(pipes, up).select("node", "consumers", "flow")
    same = up.join(n, "node").join(n.select(F.col("node").alias("above"), F.col("consumers").alias("of_above")), "above").where("consumers = of_above")
    head = same.groupBy("node").agg(F.max_by("above", "depth").alias("head"), F.first("flow").alias("flow"))
    return head.join(pipes.select("node", "length_m"), "node").groupBy("head").agg(F.count(F.lit(1)).alias("pipes"), F.sum("length_m").alias("length_m"), F.max("flow").alias("flow"))


def same_dn_length(pipes: DataFrame, up: DataFrame) -> DataFrame:
    """node, length_m: how far up from each pipe the DN stays the same, itself included."""
    dn = up.join(pipes.select("node", F.col("dn").alias("own")), "node").join(pipes.select(F.col("node").alias("above"), "dn", "length_m"), "above")
    w = Window.partitionBy("node").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    same = dn.withColumn("_changed", F.max((F.col("dn") != F.col("own")).cast("int")).over(w)).where("_changed = 0")
    return same.groupBy("node").agg(F.sum("length_m").alias("length_m"))


def sized(pipes: DataFrame, up: DataFrame, dn_rows: DataFrame, most_rounds: int = 20) -> DataFrame:
    """node, dn: the least diameters that carry the flow, do not grow from the root on, and are not longer in a row than allowed.

    DNs go up by one where a run is too long, until none is; each goes up 18 times at most, the last time to null, so it ends. A pipe
    whose flow no DN carries has a null one, and so has all that leads to it. Only what went up is carried to the root again. No
    join of pipes goes through the driver: each round has several, and broadcasts of what is just small enough would add up there.
    """
    from pipeweave.storage import Scratch

    scratch = Scratch(pipes.sparkSession, "sized")
    table = dn_rows.select("dn", "capacity", "max_length")
    flow = consumers(pipes, up).select("node", F.col("flow").alias("total"))
    rows = pipes.select("node", "length_m").join(flow.hint("shuffle_hash"), "node", "left").withColumn("total", F.coalesce("total", F.lit(0.0)))
    fit = rows.join(F.broadcast(table), F.expr("total <= capacity + 1e-9"), "left").groupBy("node", "length_m").agg(F.min("dn").alias("dn"))  # 18 rows
    nexts = table.select("dn", "max_length", F.lead("dn").over(Window.orderBy("dn")).alias("larger"))
    grown, by_dn = scratch.keep(fit, "dn"), F.struct(F.col("dn").isNull(), "dn")  # a null DN is the greatest
    current = grown
    for _ in range(most_rounds):
        below = up.join(grown.select("node", "dn").hint("shuffle_hash"), "node").groupBy(F.col("above").alias("node")).agg(F.max(by_dn).alias("_dn"))
        raised = current.join(below.hint("shuffle_hash"), "node", "left").select("node", "length_m", F.greatest(by_dn, "_dn").getField("dn").alias("dn"))
        mono = scratch.keep(raised, "mono")
        long = _same_monotone(mono, up).withColumnRenamed("length_m", "run_m")
        wide = mono.join(long.hint("shuffle_hash"), "node", "left").join(F.broadcast(nexts), "dn", "left").withColumn("_long", F.coalesce(F.expr("run_m > max_length + 1e-6"), F.lit(False)))
        current = scratch.keep(wide.select("node", "length_m", F.when(F.col("_long"), F.col("larger")).otherwise(F.col("dn")).alias("dn"), "_long"), "dn")
        grown = current.where("_long")
        if grown.isEmpty():
            break
    else:
        raise ValueError(f"diameters are not settled after {most_rounds} rounds")
    return current.select("node", "dn")


def _same_monotone(pipes: DataFrame, up: DataFrame) -> DataFrame:
    """same_dn_length where DNs do not fall towards the root, null being the greatest: what is equal above is equal all the way, so no
    way is put in order. As there, null DNs count as the same where they follow at once."""
    own = pipes.where("dn is not null").select("node", F.col("dn").alias("own"))
    at = up.join(pipes.select(F.col("node").alias("above"), "dn", "length_m").hint("shuffle_hash"), "above").join(own.hint("shuffle_hash"), "node")
    sums = at.groupBy("node", "own").agg(F.sum(F.expr("CASE WHEN dn = own THEN length_m END")).alias("same"), F.sum(F.expr("CASE WHEN dn IS NULL THEN length_m END")).alias("none"), F.max("dn").alias("most"))
    return sums.select("node", F.expr("same + CASE WHEN most = own THEN coalesce(none, 0.0D) ELSE 0.0D END").alias("length_m"))


def node_kinds(pipes: DataFrame) -> DataFrame:
    """node, degree, dn (the greatest that meets there) and kind: chamber where pipes part or a tree starts, oks at a consumer, technical where the DN changes, else joint."""
    below = pipes.where(F.col("parent") != ROOT).groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.max("dn").alias("hi"), F.min("dn").alias("lo"))
    at = pipes.join(below, "node", "left").withColumn("degree", 1 + F.coalesce("n", F.lit(0)))
    kind = F.when((F.col("parent") == ROOT) | (F.col("degree") >= 3), "chamber").when(F.col("flow") > 0, "oks").when((F.col("lo") != F.col("dn")) | (F.col("hi") != F.col("dn")), "technical").otherwise("joint")
    return at.select("node", "degree", F.greatest("dn", F.coalesce("hi", "dn")).alias("dn"), kind.alias("kind"))


def stranded(pipes: DataFrame, gone: DataFrame, up: DataFrame) -> DataFrame:
    """The nodes that are left when the pipes of gone (node) are taken out, with all that hangs on them."""
    lost = up.join(gone.select(F.col("node").alias("above")), "above", "left_semi").select("node").distinct()
    return pipes.join(lost, "node", "left_anti")


def tree_paths(pipes: DataFrame) -> DataFrame:
    return paths_up(pipes.select("node", "parent"), ROOT)


def jaccard(sets: DataFrame, key: str, items: str) -> DataFrame:
    """a, b, common, all_, share of each pair of a few sets: how alike variants of one plan are."""
    one = sets.select(F.col(key).alias("a"), F.col(items).alias("_x"))
    two = sets.select(F.col(key).alias("b"), F.col(items).alias("_y"))
    pairs = one.join(two, F.col("a") < F.col("b"))
    counted = pairs.select("a", "b", F.size(F.array_intersect("_x", "_y")).cast("long").alias("common"), F.size(F.array_union("_x", "_y")).cast("long").alias("all_"))
    return counted.withColumn("share", F.col("common") / F.col("all_"))


def best_plan(plans: DataFrame, key: str) -> DataFrame:
    """One plan of each key: without problems first, then by more connected, fewer problems, shorter, smaller id."""
    w = Window.partitionBy(key).orderBy((F.col("problems") > 0).cast("int"), F.desc("connected"), "problems", "length_m", "plan")
    return plans.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def depth_violations(profile: DataFrame, key: str, at: str, depth: str, least: float = 0.7, slope: float = 0.10, normal: float = 3.0) -> DataFrame:
    """key, at and code of each knot of a depth profile that is too shallow, too steep since the one before, or past the normal depth without a knot there."""
    w = Window.partitionBy(key).orderBy(at)
    before = profile.withColumns({"_s": F.lag(at).over(w), "_h": F.lag(depth).over(w)})
    steep = F.abs(F.col(depth) - F.col("_h")) > slope * (F.col(at) - F.col("_s")) + 1e-9
    past = (F.least(depth, "_h") < normal - 1e-9) & (F.greatest(depth, "_h") > normal + 1e-9)
    codes = F.array(F.when(F.col(depth) < least - 1e-9, "TOO_SHALLOW"), F.when(steep, "TOO_STEEP"), F.when(past, "PAST_NORMAL_DEPTH"))
    return before.select(key, at, F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code"))


def cut_at_knots(sections: DataFrame, knots: DataFrame, key: str) -> DataFrame:
    """Sections (key, from_m, to_m, coefficient) cut at the knots (key, at_m, depth_m) of a depth profile, with the mean depth of each piece."""
    w = Window.partitionBy(key).orderBy("at_m")
    spans = knots.select(key, F.col("at_m").alias("_f"), F.col("depth_m").alias("_a"), F.lead("at_m").over(w).alias("_t"), F.lead("depth_m").over(w).alias("_b")).where("_t > _f")
    both = sections.join(spans, key).where("from_m < _t and to_m > _f")  # an edge has a few of either
    f, t = F.greatest("from_m", "_f"), F.least("to_m", "_t")
    depth = lambda at: F.col("_a") + (at - F.col("_f")) / (F.col("_t") - F.col("_f")) * (F.col("_b") - F.col("_a"))
    return both.select(key, f.alias("from_m"), t.alias("to_m"), "coefficient", ((depth(f) + depth(t)) / 2).alias("depth_m")).where("to_m - from_m > 1e-6")


def pieces_at_knots(edges: DataFrame, knots: DataFrame, key: str) -> DataFrame:
    """key and pieces, an array of (from_m, to_m, coefficient, depth_m): sections cut at the knots of a depth profile, with the mean depth of each piece.

    edges: key, sections (an array of from_m, to_m, coefficient, in order); knots: key, at_m, depth_m. An edge has a few of either, so both come as arrays,
    an edge in a row. Edges without sections or without two knots have no row.
    """
    spans = knots.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at_m", "depth_m"))).alias("_k"))
    both = edges.join(spans, key)
    span = "filter(transform(_k, (k, i) -> struct(k.at_m AS f, k.depth_m AS a, get(_k, i + 1).at_m AS t, get(_k, i + 1).depth_m AS b)), k -> k.t > k.f)"
    met = f"flatten(transform(sections, s -> transform(filter({span}, k -> s.from_m < k.t AND s.to_m > k.f), k -> struct(greatest(s.from_m, k.f) AS from_m, least(s.to_m, k.t) AS to_m, s.coefficient AS coefficient, k.f AS f, k.a AS a, k.t AS t, k.b AS b))))"
    depth = lambda at: f"(k.a + ({at} - k.f) / (k.t - k.f) * (k.b - k.a))"
    pieces = f"transform(filter({met}, k -> k.to_m - k.from_m > 1e-6), k -> struct(k.from_m AS from_m, k.to_m AS to_m, k.coefficient AS coefficient, ({depth('k.from_m')} + {depth('k.to_m')}) / 2 AS depth_m))"
    return both.select(key, F.expr(pieces).alias("pieces")).where("size(pieces) > 0")
