"""Spatial scenes in whole metres, derived from the keys of the star-schema tables.

Each scene is one SQL query that Spark and other engines run alike; coordinates are local, from 0 to
about 4000 at scale factors of up to 0.01. A scene reads one base table, a count and a few constants.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pipeweave.functions.rules import dn_sql

_TYPES = "oks park social_area prohibited_site water railway road tram_tracks gas_pipeline power_cable swamp".split()
_TYPE = "CASE p_partkey % 11 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TYPES)) + " END"

#: The side of the area grows with the square root of the rows, so that what is near what does not grow with the square of them.
_SIDE = "(SELECT 4000 * CAST(ceil(sqrt(count(*) / 2000.0)) AS BIGINT) FROM part)"

SCENES = {
    "g_target": f"""SELECT c_custkey AS ordinal, CAST((c_custkey * 7919) % {_SIDE} AS DOUBLE) AS x, CAST((c_custkey * 6101) % {_SIDE} AS DOUBLE) AS y,
        abs(c_acctbal) / 400 AS flow, c_nationkey AS nation FROM customer""",
    "g_line": f"""SELECT s.ordinal, s.seq, CAST(s.ax AS DOUBLE) AS ax, CAST(s.ay AS DOUBLE) AS ay, CAST(s.ex AS DOUBLE) AS ex, CAST(s.ey AS DOUBLE) AS ey, d.dn FROM (
        SELECT s_suppkey AS ordinal, 0 AS seq, (s_suppkey * 7621) % {_SIDE} AS ax, (s_suppkey * 5471) % {_SIDE} AS ay,
            (s_suppkey * 7621) % {_SIDE} + 20 + (s_suppkey * 37) % 300 AS ex, (s_suppkey * 5471) % {_SIDE} + (s_suppkey * 53) % 400 - 200 AS ey FROM supplier
        UNION ALL SELECT s_suppkey AS ordinal, 1 AS seq, (s_suppkey * 7621) % {_SIDE} + 20 + (s_suppkey * 37) % 300 AS ax, (s_suppkey * 5471) % {_SIDE} + (s_suppkey * 53) % 400 - 200 AS ay,
            (s_suppkey * 7621) % {_SIDE} + 20 + (s_suppkey * 37) % 300 + 10 + (s_suppkey * 71) % 150 AS ex, (s_suppkey * 5471) % {_SIDE} + (s_suppkey * 53) % 400 - 150 AS ey
            FROM supplier WHERE s_suppkey % 2 = 0) s JOIN {dn_sql()} d ON d.idx = s.ordinal % 18""",
    "g_chamber": f"""SELECT 1000000 + s_suppkey AS ordinal, CAST((s_suppkey * 7621) % {_SIDE} + 20 + (s_suppkey * 37) % 300 AS DOUBLE) AS x,
        CAST((s_suppkey * 5471) % {_SIDE} + (s_suppkey * 53) % 400 - 200 AS DOUBLE) AS y FROM supplier WHERE s_suppkey % 3 = 0""",
    "g_obstacle": f"""SELECT ordinal, type, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x0 + w AS DOUBLE) AS x1, CAST(y0 + h AS DOUBLE) AS y1 FROM (
        SELECT p_partkey AS ordinal, {_TYPE} AS type, (p_partkey * 4241) % {_SIDE} AS x0, (p_partkey * 3559) % {_SIDE} AS y0, p_size % 30 + 5 AS w, p_size % 20 + 5 AS h FROM part) p""",
    "g_utility": f"""SELECT ordinal, type, CAST(x0 AS DOUBLE) AS cx, CAST(y0 AS DOUBLE) AS cy, CAST(x0 + w AS DOUBLE) AS dx, CAST(y0 + h AS DOUBLE) AS dy FROM (
        SELECT p_partkey AS ordinal, {_TYPE} AS type, (p_partkey * 4241) % {_SIDE} AS x0, (p_partkey * 3559) % {_SIDE} AS y0, p_size % 30 + 35 AS w, p_size % 20 - 9 AS h FROM part
        WHERE p_partkey % 11 IN (8, 9)) p""",
    "g_segment": f"""SELECT o.seg_id, CAST(o.ax AS DOUBLE) AS ax, CAST(o.ay AS DOUBLE) AS ay, CAST(o.ax + o.dx AS DOUBLE) AS ex, CAST(o.ay + o.dy AS DOUBLE) AS ey, d.dn, d.width FROM (
        SELECT o_orderkey AS seg_id, (o_orderkey * 7919) % {_SIDE} AS ax, (o_orderkey * 6101) % {_SIDE} AS ay, 10 + (o_orderkey * 31) % 110 AS dx, (o_orderkey * 17) % 150 - 75 AS dy
        FROM orders) o JOIN {dn_sql()} d ON d.idx = o.seg_id % 18""",
    "g_section": """SELECT l_orderkey AS edge_id, l_linenumber AS passage, CAST((l_linenumber - 1) * 12 + l_quantity % 7 AS DOUBLE) AS from_m,
        CAST((l_linenumber - 1) * 12 + l_quantity % 7 + 4 + l_quantity % 13 AS DOUBLE) AS to_m, CAST(110 AS DOUBLE) AS length_m,
        CAST(CASE l_partkey % 5 WHEN 0 THEN 1.05 WHEN 1 THEN 1.15 WHEN 2 THEN 1.25 WHEN 3 THEN 1.60 ELSE 1.75 END AS DOUBLE) AS k FROM lineitem""",
    "g_edge": """SELECT 'c' || CAST(c_custkey AS VARCHAR(20)) AS node, 'n' || CAST(c_nationkey AS VARCHAR(20)) AS parent, abs(c_acctbal) / 400 AS flow, CAST(20 + (c_custkey * 13) % 180 AS DOUBLE) AS length_m FROM customer
        UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR(20)) AS node, 'r' || CAST(n_regionkey AS VARCHAR(20)) AS parent, 0.0 AS flow, CAST(50 + n_nationkey * 7 AS DOUBLE) AS length_m FROM nation
        UNION ALL SELECT 'r' || CAST(r_regionkey AS VARCHAR(20)) AS node, 'root' AS parent, 0.0 AS flow, CAST(100 + r_regionkey * 10 AS DOUBLE) AS length_m FROM region""",
    "g_request": "SELECT event_id, ts, user_id, event_type, value, props FROM events",
}
_READS = {
    "g_target": ("customer", "part"), "g_line": ("supplier", "part"), "g_chamber": ("supplier", "part"), "g_obstacle": ("part",), "g_utility": ("part",), "g_segment": ("orders", "part"),
    "g_section": ("lineitem",), "g_edge": ("customer", "nation", "region"), "g_request": ("events",),
}


def scene(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A scene over the tables of a folder. No view is registered: folders do not get into each other's way."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _READS[name]}
    text = SCENES[name]
    for t in tables:
        text = _braced(text, t)
    return spark.sql(text, **tables)


def _braced(text: str, table: str) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 {{{table}}}", text)


def with_scenes(body: str, *names: str) -> str:
    """SQL with the named scenes as common table expressions."""
    return "WITH " + ", ".join(f"{n} AS ({SCENES[n]})" for n in names) + (", " if body.lstrip().upper().startswith("WITH ") else " ") + (body.lstrip()[5:] if body.lstrip().upper().startswith("WITH ") else body)
