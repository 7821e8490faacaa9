"""Violation queries on exported results: every function returns the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipeweave.functions import rules

# The coefficients a special section may have.
COEFFICIENTS = (1.05, 1.15, 1.25, 1.60, 1.75)


def cost_identity(lines: DataFrame, dn_rows: DataFrame) -> DataFrame:
    """Lines whose cost is not length x rate x an allowed coefficient x depth coefficient. lines: id, dn, length_m, kgl, special, cost."""
    at = lines.join(F.broadcast(dn_rows.select("dn", "rate")), "dn").withColumn("k", F.expr("cost / (length_m * rate * kgl)"))
    one_of = " OR ".join(f"abs(k - {k}) <= 1e-6" for k in COEFFICIENTS)
    return at.where(f"NOT CASE WHEN special THEN {one_of} ELSE abs(k - 1) <= 1e-6 END").select("id", "k")


def summaries(variants: DataFrame) -> DataFrame:
    """Variants whose sums or score do not add up. variants: variant_id, network, chambers, ties, penalty, calculated, length_m, score.

    A sum may be off by a cent, and by what doubles round in adding four numbers; no more, or large plans would hide errors.
    """
    off = lambda a, b: f"abs({a} - ({b})) > greatest(0.01, 1e-14 * abs({b}))"
    total = "network + chambers + ties + penalty"
    wrong = F.concat_ws(",", F.when(F.expr(off("calculated", total)), "calculated"), F.when(F.expr(f"abs(score - ({rules.score('calculated', 'length_m')})) > 1e-6"), "score"))
    return variants.select("variant_id", wrong.alias("wrong")).where("wrong <> ''")


def ranks(variants: DataFrame) -> DataFrame:
    """Variants of a request whose ranks are not 1, 2, ... by growing score."""
    w = Window.partitionBy("request").orderBy("rank", "variant_id")
    at = variants.withColumns({"n": F.row_number().over(w), "before": F.lag("score").over(w)})
    return at.where("rank <> n OR before > score + 1e-9").select("variant_id", "rank", "n")


def references(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ends of lines that name no node. lines: id, start, end; nodes: node."""
    ends = lines.select("id", F.explode(F.create_map(F.lit("start"), "start", F.lit("end"), "end")).alias("which", "node"))
    return ends.join(nodes.select("node").distinct(), "node", "left_anti").select("id", "which", "node")


def tree_flow(edges: DataFrame, below: DataFrame, dn_rows: DataFrame) -> DataFrame:
    """Edges whose stated flow differs from what hangs below by more than 0.011, or exceeds their DN's capacity."""
    at = edges.join(below.select("node", F.col("flow").alias("flow_below")), "node").join(F.broadcast(dn_rows.select("dn", "capacity")), "dn", "left")
    wrong = F.concat_ws(",", F.when(F.expr("abs(stated - flow_below) > 0.011"), "flow"), F.when(F.expr("flow_below > capacity + 1e-9 OR capacity IS NULL"), "capacity"))
    return at.select("node", wrong.alias("wrong")).where("wrong <> ''")
