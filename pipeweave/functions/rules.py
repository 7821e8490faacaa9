"""Rule tables and the scalar rules of sizing, pricing and depth.

Scalars are SQL text over column names, so that one formula serves DataFrame expressions and SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Pipe sizes. Columns: DN, width m, height m, capacity t/h, longest run m, rate per m, chamber price.
DN_ROWS = (
    (50, 0.400, 0.125, 3.5, 181, 74023, 3000000),
    (65, 0.430, 0.140, 8.3, 245, 78631, 3000000),
    (80, 0.470, 0.160, 13.2, 327, 83530, 3000000),
    (100, 0.510, 0.180, 22.3, 419, 89748, 3000000),
    (125, 0.600, 0.225, 40.2, 554, 97275, 3000000),
    (150, 0.650, 0.250, 65.1, 696, 105507, 3000000),
    (200, 0.880, 0.315, 152.3, 1042, 120275, 3000000),
    (250, 1.050, 0.400, 274.9, 1379, 135323, 5000000),
    (300, 1.150, 0.450, 437.4, 1718, 150022, 5000000),
    (400, 1.370, 0.560, 943.1, 2477, 190299, 5000000),
    (500, 1.670, 0.710, 1663.4, 3245, 224137, 5000000),
    (600, 1.850, 0.800, 2627.7, 4037, 264790, 8000000),
    (700, 2.050, 0.900, 3735.1, 4775, 324298, 8000000),
    (800, 2.250, 1.000, 5296.8, 5644, 325996, 8000000),
    (900, 2.450, 1.100, 7165.0, 6518, 327693, 8000000),
    (1000, 2.650, 1.200, 9391.8, 7419, 418777, 8000000),
    (1200, 3.100, 1.425, 15012.8, 9288, 428074, 12000000),
    (1400, 3.450, 1.600, 22501.9, 11276, 683417, 12000000),
)
# Restriction types. Columns: type, special, clearance m, margin m, least crossing angle, coefficient, obstacle width m.
RULE_ROWS = (
    ("oks", False, 5.0, 0.0, 0.0, 1.00, 0.0),
    ("park", False, 1.0, 0.0, 0.0, 1.00, 0.0),
    ("social_area", False, 1.0, 0.0, 0.0, 1.00, 0.0),
    ("prohibited_site", False, 1.0, 0.0, 0.0, 1.00, 0.0),
    ("water", False, 1.0, 0.0, 0.0, 1.00, 0.0),
    ("railway", False, 1.0, 0.0, 0.0, 1.00, 0.0),
    ("road", True, 1.5, 3.0, 45.0, 1.60, 0.0),
    ("tram_tracks", True, 1.5, 3.0, 45.0, 1.75, 0.0),
    ("gas_pipeline", True, 2.0, 2.0, 0.0, 1.25, 0.40),
    ("power_cable", True, 2.0, 2.0, 0.0, 1.15, 0.20),
)
# Prices and tolerances.
TIE_IN, PENALTY, PENALTY_FLOW = 5000000, 100000000, 500000
EPS = 1e-6
# Depths in metres and the steepest slope.
NORMAL_DEPTH, LEAST_DEPTH, SLOPE = 3.0, 0.7, 0.10
# What a passage asks of the depth of the pipe's top, in metres. Columns: type, least depth.
LEAST_UNDER = (("road", 1.0), ("tram_tracks", 1.2))
# What lies in the way of the pipe. Columns: type, its top, its height (None: by its DN), gap above and below.
IN_THE_WAY = (("gas_pipeline", 2.8, 0.4, 0.2), ("power_cable", 2.7, 0.2, 0.5), ("heat_network", 3.0, None, 0.5))
UNKNOWN_HEIGHT = 1.6


def allowed_depths(type_: str, height: float, existing: float | None = None) -> list[tuple[float, float]]:
    """Intervals for the depth of the top of a pipe of this height at a passage; existing: height of a heat network in the way."""
    for name, least in LEAST_UNDER:
        if name == type_:
            return [(least, float("inf"))]
    for name, top, tall, gap in IN_THE_WAY:
        if name == type_:
            tall = (UNKNOWN_HEIGHT if existing is None else existing) if tall is None else tall
            return [(LEAST_DEPTH, top - gap - height), (top + tall + gap, float("inf"))]
    return [(LEAST_DEPTH, float("inf"))]


def _values(rows: tuple, names: str) -> str:
    text = lambda v: f"'{v}'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else f"CAST({v} AS {'DOUBLE' if isinstance(v, float) else 'BIGINT'})"
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS t({names}))"


def dn_sql() -> str:
    """The pipe sizes as a subquery, numbered from 0."""
    return _values(tuple((i, *r) for i, r in enumerate(DN_ROWS)), "idx, dn, width, height, capacity, max_length, rate, chamber")


def rule_sql() -> str:
    return _values(RULE_ROWS, "type, special, clearance, margin, least_angle, k, obstacle_width")


def dn_table(spark: SparkSession) -> DataFrame:
    """18 rows; small enough to broadcast whatever the data."""
    return spark.sql(dn_sql()[1:-1])


def rule_table(spark: SparkSession) -> DataFrame:
    """One row a restriction type."""
    return spark.sql(rule_sql()[1:-1])


def clearance(type_: str, dn: str, base: str) -> str:
    """Clearance from the pipe's edge; buildings keep more from larger pipes."""
    return f"CASE WHEN {type_} = 'oks' THEN CASE WHEN {dn} < 500 THEN 5.0 WHEN {dn} <= 800 THEN 7.0 ELSE 9.0 END ELSE {base} END"


def axis_clearance(type_: str, dn: str, base: str, width: str, obstacle_width: str) -> str:
    return f"({clearance(type_, dn, base)} + ({width} + {obstacle_width}) / 2)"


def kgl(h: str) -> str:
    """Depth coefficient."""
    return f"(CASE WHEN {h} <= 3.0 THEN 1.0 ELSE 1.0 + 0.1 * ({h} - 3.0) END)"


def ramp(a: str, b: str) -> str:
    """Mean depth coefficient of a straight ramp from depth a to b, split where it passes 3 m."""
    hi, lo = f"greatest({a}, {b})", f"least({a}, {b})"
    return (
        f"(CASE WHEN {hi} <= 3.0 THEN 1.0 WHEN {lo} >= 3.0 THEN ({kgl(a)} + {kgl(b)}) / 2 "
        f"ELSE ((3.0 - {lo}) + ({hi} - 3.0) * (1.0 + {kgl(hi)}) / 2) / ({hi} - {lo}) END)"
    )


def penalty(flow: str) -> str:
    return f"({PENALTY} + {PENALTY_FLOW} * {flow})"


def score(cost: str, length: str) -> str:
    return f"(0.7 * ({cost} / 25000000.0) + 0.3 * ({length} / 100.0))"
