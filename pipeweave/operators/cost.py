"""Prices of edges and variants, and checks of what was priced."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipeweave.functions import rules


def priced(rows: DataFrame) -> DataFrame:
    """rows (weighted_m, rate) with cost: length x rate x coefficient."""
    return rows.withColumn("cost", F.col("weighted_m") * F.col("rate"))


def edge_cost(sections: DataFrame, edges: DataFrame, dn_rows: DataFrame) -> DataFrame:
    """edge_id, length_m, weighted_m and cost: length x rate x coefficient, summed over the sections of an edge."""
    per = sections.groupBy("edge_id").agg(F.sum(F.expr("to_m - from_m")).alias("length_m"), F.sum(F.expr("(to_m - from_m) * coefficient")).alias("weighted_m"))
    sized = per.join(edges.select("edge_id", "dn"), "edge_id").join(F.broadcast(dn_rows.select("dn", "rate")), "dn")
    return priced(sized).select("edge_id", "length_m", "weighted_m", "cost")


def summary(parts: DataFrame) -> DataFrame:
    """One row per variant. parts: variant_id, network, chambers, tie_ins (how many), unconnected_flow (null if connected), length_m."""
    lost = F.sum(F.when(F.col("unconnected_flow").isNotNull(), F.expr(rules.penalty("unconnected_flow"))).otherwise(0.0))
    out = parts.groupBy("variant_id").agg(
        F.sum("network").alias("network"), F.sum("chambers").alias("chambers"), (F.sum("tie_ins") * rules.TIE_IN).alias("ties"), lost.alias("penalty"), F.sum("length_m").alias("length_m")
    )
    total = out.withColumn("construction", F.expr("network + chambers + ties")).withColumn("calculated", F.expr("construction + penalty"))
    return total.withColumn("score", F.expr(rules.score("calculated", "length_m")))


def ranked(variants: DataFrame) -> DataFrame:
    """Rank by score, cost, length and id; variants are few by definition (profiles of one request)."""
    return variants.withColumn("rank", F.row_number().over(Window.partitionBy("request").orderBy("score", "calculated", "length_m", "variant_id")))


def alike(variants: DataFrame) -> DataFrame:
    """(request, a, b) for each two variants of a request that are no two plans: same roots, lengths less than the
    greater of 25 m and a tenth of the shorter one apart, and 0.65 or more of their places in common.

    variants: request, variant, length_m, roots and shape (sets, sorted); a request has a handful of variants, its
    profiles. Two variants without places are alike if the rest is. Fixed values: 25, 0.10, 0.65.
    """
    left, right = (variants.select("request", *[F.col(c).alias(c + s) for c in ("variant", "length_m", "roots", "shape")]) for s in "ab")
    two = left.join(right, "request").where("varianta < variantb AND rootsa <=> rootsb")
    near = two.where("abs(length_ma - length_mb) < greatest(25, 0.10 * greatest(1, least(length_ma, length_mb)))")
    common, whole = F.size(F.array_intersect("shapea", "shapeb")), F.size(F.array_union("shapea", "shapeb"))
    return near.where((whole == 0) | (common / whole >= 0.65)).select("request", F.col("varianta").alias("a"), F.col("variantb").alias("b"))
