"""Features out: WKB, GeoJSON lines, and a generator of test imports."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType


@F.pandas_udf(BinaryType())
def wkb_line(xs: pd.Series, ys: pd.Series) -> pd.Series:
    """Big-endian 2-D WKB of a point (one vertex) or a line string."""

    def one(x, y) -> bytes:
        flat = [float(v) for p in zip(x, y, strict=True) for v in p]
        head = struct.pack(">BI", 0, 1) if len(x) == 1 else struct.pack(">BII", 0, 2, len(x))
        return head + struct.pack(f">{len(flat)}d", *flat)

    return pd.Series([None if x is None else one(x, y) for x, y in zip(xs, ys, strict=True)])


def feature_line(kind: str, properties: list[str], coordinates: Column) -> Column:
    """One GeoJSON feature as text; coordinates are an array of numbers or of pairs."""
    geometry = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry")))


def chains(atoms: DataFrame) -> DataFrame:
    """Atoms of one path in a row with equal parameters, as one line each: path, run, dn, length_m, xs, ys.

    atoms: path, i, dn, ax, ay, ex, ey. A path's atoms are some hundred at most.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("i")
    new = F.when((F.col("dn") == F.lag("dn").over(w)) & (F.col("ax") == F.lag("ex").over(w)) & (F.col("ay") == F.lag("ey").over(w)), 0).otherwise(1)
    run = atoms.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = run.groupBy("path", "run", "dn").agg(
        F.sum(F.expr("sqrt((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay))")).alias("length_m"), F.sort_array(F.collect_list(F.struct("i", "ax", "ay", "ex", "ey"))).alias("a")
    )
    along = lambda first, end: F.concat(F.array(F.col("a")[0][first]), F.transform("a", lambda v: v[end]))
    xs, ys = along("ax", "ex"), along("ay", "ey")
    return rows.select("path", "run", "dn", "length_m", xs.alias("xs"), ys.alias("ys"))


def synthetic(spark: SparkSession, n: int) -> DataFrame:
    """n chambers on a 250 x 250 micro-grid around one point, as GeoJSON lines."""
    at = F.array(F.lit(37.6) + (F.col("id") % 250) * 1e-5, F.lit(55.75) + (F.floor(F.col("id") / 250) % 250) * 1e-5)
    props = [F.concat(F.lit("load-"), F.col("id")).alias("id"), F.lit("heat_chamber").alias("object_type")]
    return spark.range(n).select(F.col("id").alias("ordinal"), feature_line("Point", props, at).alias("line"))
