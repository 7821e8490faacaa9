"""Decisions on candidate pipe segments against obstacles, in batches.

A segment may pass an obstacle at its clearance, cross a special one (road, tram, gas, cable) inside a
passage, and nothing else. Unknown types never allow anything: they leave the decision open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipeweave.functions import geo, rules
from pipeweave.operators.cells import near_join

S, B, U = ("ax", "ay", "ex", "ey"), ("x0", "y0", "x1", "y1"), ("cx", "cy", "dx", "dy")
#: The largest clearance from a pipe's axis, and the cell size that goes with it.
REACH, CELL = 12.0, 64.0


def boxed(segments: DataFrame, s: tuple[str, ...] = S) -> DataFrame:
    ax, ay, ex, ey = s
    return segments.withColumns({"_x0": F.least(ax, ex), "_y0": F.least(ay, ey), "_x1": F.greatest(ax, ex), "_y1": F.greatest(ay, ey)})


#: What every comparison of a segment needs, computed once a segment and not once a pair.
_DIRECTION = {"_dx": "ex - ax", "_dy": "ey - ay", "_sq": "nullif((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay), 0.0)"}


def _box_distance() -> str:
    """0 where a segment meets a box, else the least distance of its ends to the box and of the box's corners to it.

    They meet if they overlap on both axes and across the segment. Kept short: generated code that is split
    into methods does not compile within a join.
    """

    def corner(x: str, y: str) -> str:
        t = f"coalesce(least(1.0, greatest(0.0, (({x} - ax) * _dx + ({y} - ay) * _dy) / _sq)), 0.0)"
        return f"pow({x} - (ax + {t} * _dx), 2) + pow({y} - (ay + {t} * _dy), 2)"

    end = lambda x, y: f"pow(greatest(x0 - {x}, 0.0, {x} - x1), 2) + pow(greatest(y0 - {y}, 0.0, {y} - y1), 2)"
    across = "abs((x0 + x1 - 2 * ax) * _dy - (y0 + y1 - 2 * ay) * _dx) <= (x1 - x0) * abs(_dy) + (y1 - y0) * abs(_dx)"
    meet = f"_x0 <= x1 AND _x1 >= x0 AND _y0 <= y1 AND _y1 >= y0 AND {across}"
    return f"CASE WHEN {meet} THEN 0.0 ELSE sqrt(least({end('ax', 'ay')}, {end('ex', 'ey')}, {', '.join(corner(x, y) for x in ('x0', 'x1') for y in ('y0', 'y1'))})) END"


_BOX_DISTANCE = _box_distance()


def candidates(segments: DataFrame, obstacles: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """Pairs of a segment and an obstacle box within REACH, with distance_m, the type's rule, required_m and the excess of the distance over it."""
    pairs = near_join(boxed(segments).withColumns({k: F.expr(v) for k, v in _DIRECTION.items()}), obstacles, ("_x0", "_y0", "_x1", "_y1"), B, REACH, CELL)
    pairs = pairs.withColumn("distance_m", F.expr(_BOX_DISTANCE)).where(F.col("distance_m") <= REACH).drop("_x0", "_y0", "_x1", "_y1", *_DIRECTION)
    known = pairs.join(F.broadcast(rule_rows), "type", "left")  # one row a type
    return known.withColumn("required_m", F.expr(rules.axis_clearance("type", "dn", "clearance", "width", "obstacle_width")))


REASON = (
    "CASE WHEN special IS NULL THEN 'UNKNOWN_RESTRICTION' WHEN distance_m + 1e-6 >= required_m THEN NULL "
    "WHEN NOT special THEN CASE WHEN distance_m <= 0 THEN 'FORBIDDEN_INTERSECTION' ELSE 'CLEARANCE' END "
    "WHEN distance_m > 0 THEN 'CLEARANCE' WHEN NOT (enters > 0 AND leaves < 1 AND leaves > enters) OR enters * len <= 1e-6 OR (1 - leaves) * len <= 1e-6 THEN 'TOUCH_OVERLAP_OR_INCOMPLETE_CROSSING' "
    "WHEN angle + 1e-7 < least_angle THEN 'CROSSING_ANGLE' WHEN from_m < 0 OR to_m > len THEN 'SPECIAL_PASSAGE_OUTSIDE_SEGMENT' END"
)


def crossings(pairs: DataFrame) -> DataFrame:
    """Adds where a segment enters and leaves the box, the angle, and the zone of the passage around it."""
    at = pairs.withColumns({"enters": F.expr(geo.enters(S, B)), "leaves": F.expr(geo.leaves(S, B)), "len": F.expr(geo.length(S)), "angle": F.expr(geo.box_angle(S, B))})
    wide = "greatest(margin, required_m / greatest(sin(radians(angle)), 0.05) + 1e-6)"
    return at.withColumns({"from_m": F.expr(f"enters * len - {wide}"), "to_m": F.expr(f"leaves * len + {wide}")})


def reasons(pairs: DataFrame) -> DataFrame:
    """One row per pair with the first reason against it, null if there is none."""
    return crossings(pairs).withColumn("reason", F.expr(REASON))


def decide(segments: DataFrame, judged: DataFrame) -> DataFrame:
    """seg_id, status, allowed (null when open), violations, unresolved. Segments without obstacles are allowed."""
    per = judged.groupBy("seg_id").agg(
        F.count_if(F.col("reason").isNotNull() & (F.col("reason") != "UNKNOWN_RESTRICTION")).alias("v"), F.count_if(F.col("reason") == "UNKNOWN_RESTRICTION").alias("u")
    )
    out = segments.select("seg_id").join(per, "seg_id", "left").select("seg_id", F.coalesce("v", F.lit(0)).alias("violations"), F.coalesce("u", F.lit(0)).alias("unresolved"))
    status = F.when(F.col("violations") > 0, "BLOCKED").when(F.col("unresolved") > 0, "INDETERMINATE").otherwise("ALLOWED")
    allowed = F.when(F.col("violations") > 0, F.lit(False)).when(F.col("unresolved") > 0, F.lit(None).cast("boolean")).otherwise(True)
    return out.withColumns({"status": status, "allowed": allowed})


def line_crossings(segments: DataFrame, lines: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """Points where segments cut line obstacles: at_m, angle, and whether the line's ends lie on both sides."""
    pairs = near_join(boxed(segments), boxed(lines, U).withColumnsRenamed({"_x0": "_u0", "_y0": "_v0", "_x1": "_u1", "_y1": "_v1"}), ("_x0", "_y0", "_x1", "_y1"), ("_u0", "_v0", "_u1", "_v1"), 0.0, CELL)
    at = pairs.withColumns({"s": F.expr(geo.meets_at(S, U)), "t": F.expr(geo.meets_at(U, S)), "len": F.expr(geo.length(S))})
    hit = at.where("s BETWEEN 0 AND 1 AND t BETWEEN 0 AND 1")
    c, d = geo.side(("cx", "cy"), S), geo.side(("dx", "dy"), S)
    both = f"least({c}, {d}) < -1e-6 AND greatest({c}, {d}) > 1e-6"
    out = hit.withColumns({"at_m": F.expr("s * len"), "angle": F.expr(geo.lines_angle(S, U)), "both_sides": F.expr(both)})
    return out.join(F.broadcast(rule_rows), "type", "left").withColumn("required_m", F.expr(rules.axis_clearance("type", "dn", "clearance", "width", "obstacle_width")))


def section_arrays(passages: DataFrame, key: str = "edge_id") -> DataFrame:
    """key and sections, an array in order of (from_m, to_m, coefficient, active, first_passage): the elementary intervals between
    all cuts of an edge, with the greatest coefficient of the passages over each.

    passages: key, passage, from_m, to_m, k, length_m. Passages are clipped to the edge; intervals of up
    to 1e-6 m are dropped. One shuffle of plain rows, sorted by edge, which Arrow batches cut into edges: no row is gathered into an array on the way.
    """
    kinds = dict(passages.dtypes)
    section = f"struct<from_m: double, to_m: double, coefficient: double, active: bigint, first_passage: {kinds['passage']}>"
    return _by_edge(passages, key, "passage").mapInArrow(_arrays, f"{key} {kinds[key]}, sections array<{section}>")


def section_lengths(passages: DataFrame, key: str = "edge_id") -> DataFrame:
    """key, length_m and weighted_m (length x coefficient), summed over the sections of section_arrays in order. Edges without sections have no row."""
    return _by_edge(passages, key).mapInArrow(_lengths, f"{key} {dict(passages.dtypes)[key]}, length_m double, weighted_m double")


def _by_edge(passages: DataFrame, key: str, *more: str) -> DataFrame:
    clipped = passages.select(key, F.greatest("from_m", F.lit(0.0)).alias("f"), F.least("to_m", "length_m").alias("t"), F.coalesce("k", F.lit(1.0)).alias("k"), "length_m", *more)
    return clipped.repartition(key).sortWithinPartitions(key)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by their first column, dealt anew so that no edge is in two batches."""
    held = []
    for batch in batches:
        if batch.num_rows:
            last = _starts(batch.column(0))[-1]
            # Nothing but the edge that may go on is held back.
            if last == 0 and (not held or _starts(pa.concat_arrays([held[-1].column(0)[-1:], batch.column(0)[:1]]))[-1] == 0):
                held.append(batch)
                continue
            ready = pa.concat_batches([*held, batch[:last]])
            held = [batch[last:]]
            if ready.num_rows:
                yield ready
    if held:
        yield pa.concat_batches(held)


def _starts(key: pa.Array) -> np.ndarray:
    """Where a run of equal keys starts, nulls being equal."""
    one, two = key[:-1], key[1:]
    same = pc.or_(pc.fill_null(pc.equal(one, two), False), pc.and_(pc.is_null(one), pc.is_null(two)))
    return np.concatenate(([0], 1 + np.flatnonzero(~same.to_numpy(zero_copy_only=False))))


def _cut(rows: pa.RecordBatch) -> tuple:
    """Keys and, of the edges' sections in order, which edge and from_m, to_m, coefficient; and each section with each passage over it, as row numbers."""
    starts = _starts(rows.column(0))
    many = np.diff(np.append(starts, rows.num_rows))
    f, t, k, length = (rows.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4))
    edge = np.repeat(np.arange(len(many)), many)
    # The passages of an edge mostly name one length: its ends are cuts once.
    new = np.concatenate(([True], (edge[1:] != edge[:-1]) | (length[1:] != length[:-1])))[: len(edge)]
    ends, of = length[new], edge[new]
    cut, at, end = np.concatenate((np.zeros(len(ends)), f, t, ends)), np.concatenate((of, edge, edge, of)), np.concatenate((ends, length, length, ends))
    within = (cut >= 0) & (cut <= end)
    cut, at = cut[within], at[within]
    order = np.lexsort((cut, at))
    cut, at = cut[order], at[order]
    step = (at[1:] == at[:-1]) & (cut[1:] - cut[:-1] > 1e-6)
    at, lo, hi = at[:-1][step], cut[:-1][step], cut[1:][step]
    n = many[at]
    section = np.repeat(np.arange(len(at)), n)  # each step with each passage of its edge
    row = np.arange(len(section)) + np.repeat(starts[at] - np.cumsum(n) + n, n)
    mid = np.repeat((lo + hi) / 2, n)
    on = (f[row] < mid) & (t[row] > mid)
    section, row = section[on], row[on]
    coefficient = np.ones(len(at))
    if len(section):
        first = np.flatnonzero(np.concatenate(([True], section[1:] != section[:-1])))
        coefficient[section[first]] = np.maximum(1.0, np.maximum.reduceat(k[row], first))
    return rows.column(0).take(pa.array(starts)), at, lo, hi, coefficient, section, row


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _edges(batches):
        keys, at, lo, hi, coefficient, section, row = _cut(rows)
        passage, none = rows.column(5), np.iinfo(np.int64).max
        first = np.full(len(at), none)
        np.minimum.at(first, section, passage.cast(pa.int64()).fill_null(none).to_numpy()[row])
        columns = [lo, hi, coefficient, np.bincount(section, minlength=len(at)), pa.array(np.where(first == none, -1, first)).cast(passage.type)]
        found = pa.StructArray.from_arrays([pa.array(c) for c in columns], ["from_m", "to_m", "coefficient", "active", "first_passage"])
        offsets = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(keys))))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(offsets), found)], [rows.schema.names[0], "sections"])


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _edges(batches):
        keys, at, lo, hi, coefficient, *_ = _cut(rows)
        some = np.bincount(at, minlength=len(keys)) > 0
        sums = [np.bincount(at, weights=v, minlength=len(keys))[some] for v in (hi - lo, (hi - lo) * coefficient)]
        yield pa.RecordBatch.from_arrays([keys.filter(pa.array(some)), *map(pa.array, sums)], [rows.schema.names[0], "length_m", "weighted_m"])


def sections(passages: DataFrame, key: str = "edge_id") -> DataFrame:
    """section_arrays, a section in a row: key, from_m, to_m, coefficient, active, first_passage."""
    return section_arrays(passages, key).select(key, F.inline("sections"))


def base_intervals(passages: DataFrame, key: str = "edge_id") -> DataFrame:
    """The parts of an edge that no passage covers."""
    w = Window.partitionBy(key).orderBy("f", "t", "passage")
    clipped = passages.withColumns({"f": F.greatest("from_m", F.lit(0.0)), "t": F.least("to_m", "length_m")})
    swept = clipped.withColumn("from_m", F.coalesce(F.max("t").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    gaps = swept.select(key, "from_m", F.col("f").alias("to_m"))
    ends = clipped.groupBy(key).agg(F.max("t").alias("from_m"), F.max("length_m").alias("to_m")).select(key, "from_m", "to_m")
    return gaps.unionByName(ends).where("to_m - from_m > 1e-6")
