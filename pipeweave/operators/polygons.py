"""Decisions on segments against obstacles of any shape: lines, polygons with holes, several parts.

An obstacle's part is one row with its edges, an array of (cx, cy, dx, dy). Pairs of segments and parts come
from a join on cells and are measured in Arrow batches; all else is higher-order functions over the edges of one part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pipeweave.functions import rules
from pipeweave.operators.cells import near_join
from pipeweave.operators.restrict import CELL, REACH, B, S, base_intervals, boxed
from pipeweave.storage import Scratch

EPS = 1e-6
EDGE = ("cx", "cy", "dx", "dy")


def parts(edges: DataFrame) -> DataFrame:
    """ordinal, component, type, polygonal, edges and box of each part. edges: one row an edge; what is made of them does not depend on their order."""
    one = F.struct(*[F.col(c).cast("double").alias(c) for c in EDGE])
    box = {"x0": F.min(F.least("cx", "dx")), "y0": F.min(F.least("cy", "dy")), "x1": F.max(F.greatest("cx", "dx")), "y1": F.max(F.greatest("cy", "dy"))}
    box = [v.cast("double").alias(k) for k, v in box.items()]
    return edges.groupBy("ordinal", "component", "type", "polygonal").agg(F.array_sort(F.collect_list(one)).alias("edges"), *box)


def inside(x: str, y: str) -> str:
    """Whether a point is inside a polygonal part: a ray to the right cuts an odd number of edges."""
    cut = f"(e.cy > {y}) <> (e.dy > {y}) AND {x} < (e.dx - e.cx) * ({y} - e.cy) / nullif(e.dy - e.cy, 0.0) + e.cx"
    return f"(polygonal AND size(filter(edges, e -> coalesce({cut}, false))) % 2 = 1)"


def to_edge(x: str, y: str, e: str = "e") -> str:
    """Distance of a point to an edge."""
    t = f"coalesce(least(1.0, greatest(0.0, (({x} - {e}.cx) * ({e}.dx - {e}.cx) + ({y} - {e}.cy) * ({e}.dy - {e}.cy)) / nullif(pow({e}.dx - {e}.cx, 2) + pow({e}.dy - {e}.cy, 2), 0.0))), 0.0)"
    return f"sqrt(pow({x} - {e}.cx - {t} * ({e}.dx - {e}.cx), 2) + pow({y} - {e}.cy - {t} * ({e}.dy - {e}.cy), 2))"


def boundary_distance(x: str, y: str) -> str:
    return f"array_min(transform(edges, e -> {to_edge(x, y)}))"


def _along(x: str, y: str) -> str:
    """Metres along the segment of the point nearest to (x, y)."""
    return f"least(_len, greatest(0.0, (({x} - ax) * (ex - ax) + ({y} - ay) * (ey - ay)) / nullif(_len, 0.0)))"


def _off(x: str, y: str) -> str:
    """Distance of (x, y) to the segment."""
    return f"sqrt(pow({x} - ax - {_along(x, y)} * (ex - ax) / nullif(_len, 0.0), 2) + pow({y} - ay - {_along(x, y)} * (ey - ay) / nullif(_len, 0.0), 2))"


_CROSS = "((ex - ax) * (e.dy - e.cy) - (ey - ay) * (e.dx - e.cx))"
_S = f"(((e.cx - ax) * (e.dy - e.cy) - (e.cy - ay) * (e.dx - e.cx)) / nullif({_CROSS}, 0.0))"
_T = f"(((e.cx - ax) * (ey - ay) - (e.cy - ay) * (ex - ax)) / nullif({_CROSS}, 0.0))"
_MEETS = f"coalesce({_S} BETWEEN -1e-12 AND 1 + 1e-12 AND {_T} BETWEEN -1e-12 AND 1 + 1e-12, false)"
_EDGE_DISTANCE = (
    f"array_min(transform(edges, e -> CASE WHEN {_MEETS} THEN 0.0 ELSE least({to_edge('ax', 'ay')}, {to_edge('ex', 'ey')}, {_off('e.cx', 'e.cy')}, {_off('e.dx', 'e.dy')}) END))"
)
_AT = ("(ax + {m} / nullif(_len, 0.0) * (ex - ax))", "(ay + {m} / nullif(_len, 0.0) * (ey - ay))")


PIECE = "struct<f: double, t: double>"


def measured(pairs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """pairs within REACH with _len, distance_m and pieces: where the segment is in or on the part, as f and t in metres, in order.

    Of a polygon, pieces are the runs between cuts that lie inside, next ones joined, and touches by points;
    of a line they are its cuts, of no length. Map only, all edges of an Arrow batch at once. keep: the columns to go
    on with, of pairs and of the new ones; all if none are named. Others, the edges above all, are then not sent back.
    """
    new = StructType.fromDDL("_len double, distance_m double, pieces array<" + PIECE + ">")
    fields = {f.name: f for f in [*pairs.schema.fields, *new.fields]}
    names = list(keep or fields)
    return pairs.mapInArrow(partial(_measure, names), StructType([fields[n] for n in names]))


def _numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _measure(names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        with np.errstate(divide="ignore", invalid="ignore"):
            yield _measured(batch, names)


def _measured(batch: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
    col = lambda name: batch.column(batch.schema.get_field_index(name))
    edges, polygonal = col("edges"), col("polygonal").to_numpy(zero_copy_only=False).astype(bool)
    many, each = edges.value_lengths().to_numpy(), edges.flatten()
    row, first = np.repeat(np.arange(len(many)), many), np.cumsum(many) - many
    cx, cy, dx, dy = (_numbers(each.field(c)) for c in EDGE)
    ax, ay, ex, ey = (_numbers(col(c)) for c in ("ax", "ay", "ex", "ey"))
    length = np.sqrt((ex - ax) ** 2 + (ey - ay) ** 2)
    sx, sy, tx, ty, metres = ax[row], ay[row], ex[row], ey[row], length[row]
    over = np.where(metres == 0, np.nan, metres)

    def inside(x: np.ndarray, y: np.ndarray, at: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """Whether points are in their parts: x and y by pairs of a point (`of`) and an edge (`at`)."""
        cut = ((cy[at] > y) != (dy[at] > y)) & (x < (dx[at] - cx[at]) * (y - cy[at]) / (dy[at] - cy[at]) + cx[at])
        return np.bincount(of[cut], minlength=n) % 2 == 1

    def to_edge(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        t = ((x - cx) * (dx - cx) + (y - cy) * (dy - cy)) / ((dx - cx) ** 2 + (dy - cy) ** 2)
        t = np.where(np.isnan(t), 0.0, np.clip(t, 0.0, 1.0))
        return np.sqrt((x - cx - t * (dx - cx)) ** 2 + (y - cy - t * (dy - cy)) ** 2)

    def along(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.fmin(metres, np.fmax(0.0, ((x - sx) * (tx - sx) + (y - sy) * (ty - sy)) / over))

    def off(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        m = along(x, y)
        return np.sqrt((x - sx - m * (tx - sx) / over) ** 2 + (y - sy - m * (ty - sy) / over) ** 2)

    cross = (tx - sx) * (dy - cy) - (ty - sy) * (dx - cx)
    none = np.where(cross == 0, np.nan, cross)
    s, t = ((cx - sx) * (dy - cy) - (cy - sy) * (dx - cx)) / none, ((cx - sx) * (ty - sy) - (cy - sy) * (tx - sx)) / none
    meets = (s >= -1e-12) & (s <= 1 + 1e-12) & (t >= -1e-12) & (t <= 1 + 1e-12)
    from_a, from_e, off_c, off_d = to_edge(sx, sy), to_edge(tx, ty), off(cx, cy), off(dx, dy)
    near = np.where(meets, 0.0, np.fmin(np.fmin(from_a, from_e), np.fmin(off_c, off_d)))
    distance = np.full(len(many), np.inf)
    np.minimum.at(distance, row, near)
    distance[inside(sx, sy, np.arange(len(row)), row, len(many)) & polygonal] = 0.0
    kept = distance <= REACH
    out = batch.select([n for n in batch.schema.names if n in names]).filter(pa.array(kept))
    found = dict(zip(out.schema.names, out.columns, strict=True)) | {"_len": pa.array(length[kept]), "distance_m": pa.array(distance[kept])}
    if "pieces" not in names:
        return pa.RecordBatch.from_arrays([found[n] for n in names], names)

    # Where the segment meets each edge: a point, or for an edge along the segment the ends of what they share.
    some, beside = kept[row], ~meets & (np.abs(cross) <= 1e-9)
    hits = [(meets, np.fmin(metres, np.fmax(0.0, s * metres))), (beside & (off_c <= EPS), along(cx, cy)), (beside & (off_d <= EPS), along(dx, dy)), (beside & (from_a <= EPS), np.zeros(len(row))), (beside & (from_e <= EPS), metres)]
    hit_of, hit = _distinct(np.concatenate([row[some & on] for on, _ in hits]), np.concatenate([m[some & on] for on, m in hits]))
    ends = np.flatnonzero(kept & polygonal)
    mine = polygonal[hit_of]
    of, cut = _distinct(np.concatenate([ends, ends, hit_of[mine]]), np.concatenate([np.zeros(len(ends)), length[ends], hit[mine]]))
    step = (of[1:] == of[:-1]) & (cut[1:] - cut[:-1] > EPS)
    of, lo, hi = of[:-1][step], cut[:-1][step], cut[1:][step]
    part = np.repeat(np.arange(len(of)), many[of])  # each step with each edge of its part
    at = np.arange(len(part)) - np.repeat(np.cumsum(many[of]) - many[of], many[of]) + np.repeat(first[of], many[of])
    mid = (lo + hi) / 2 / length[of]
    within = inside((ax[of] + mid * (ex - ax)[of])[part], (ay[of] + mid * (ey - ay)[of])[part], at, part, len(of))
    of, lo, hi = of[within], lo[within], hi[within]
    # Runs that follow each other without a gap are one.
    new = np.concatenate(([True], (of[1:] != of[:-1]) | (lo[1:] - hi[:-1] > EPS)))[: len(of)]
    last = np.concatenate((new[1:], [True]))[: len(of)]
    of, lo, hi = of[new], lo[new], hi[last]
    held = np.zeros(len(hit), dtype=bool)
    runs = np.bincount(of, minlength=len(many))
    run = np.repeat(np.arange(len(hit)), runs[hit_of])  # each hit with each run of its pair
    which = np.arange(len(run)) - np.repeat(np.cumsum(runs[hit_of]) - runs[hit_of], runs[hit_of]) + np.repeat((np.cumsum(runs) - runs)[hit_of], runs[hit_of])
    held[run[(hit[run] >= lo[which] - EPS) & (hit[run] <= hi[which] + EPS)]] = True
    of, lo, hi = np.concatenate((of, hit_of[~held])), np.concatenate((lo, hit[~held])), np.concatenate((hi, hit[~held]))
    order = np.lexsort((hi, lo, of))
    runs = pa.StructArray.from_arrays([pa.array(lo[order]), pa.array(hi[order])], ["f", "t"])
    offsets = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(many))[kept]))).astype(np.int32)
    found["pieces"] = pa.ListArray.from_arrays(pa.array(offsets), runs)
    return pa.RecordBatch.from_arrays([found[n] for n in names], names)


def _distinct(of: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places of each row, in order."""
    order = np.lexsort((at, of))
    of, at = of[order], at[order]
    new = np.concatenate(([True], (of[1:] != of[:-1]) | (at[1:] != at[:-1])))[: len(of)]
    return of[new], at[new]


def angle_at(m: str) -> str:
    """The least angle, 0 to 90 degrees, between the segment and the edges of the part through the point at m metres."""
    x, y = (v.format(m=m) for v in _AT)
    near = f"filter(edges, e -> (e.dx <> e.cx OR e.dy <> e.cy) AND {to_edge(x, y)} <= {EPS})"
    size = "sqrt(pow(e.dx - e.cx, 2) + pow(e.dy - e.cy, 2))"
    return f"array_min(transform({near}, e -> degrees(acos(least(1.0, abs((ex - ax) * (e.dx - e.cx) + (ey - ay) * (e.dy - e.cy)) / nullif(_len * {size}, 0.0))))))"


def crosses(p: str) -> str:
    """Whether a piece is a way through and not a touch: of a polygon, a run inside; of a line, edges on both sides of the segment there."""
    x, y = (v.format(m=f"{p}.f") for v in _AT)
    sides = f"flatten(transform(filter(edges, e -> {to_edge(x, y)} <= {EPS}), e -> transform(array(struct(e.cx AS x, e.cy AS y), struct(e.dx AS x, e.dy AS y)), q -> ((ex - ax) * (q.y - {y}) - (ey - ay) * (q.x - {x})) / nullif(_len, 0.0))))"
    return f"(CASE WHEN polygonal THEN {p}.t > {p}.f ELSE coalesce(array_min({sides}) < -{EPS} AND array_max({sides}) > {EPS}, false) END)"


#: A segment may run straight into the object it serves, by the shortest way from its boundary.
_APPROACH = (
    f"(polygonal AND ({inside('ex', 'ey')} OR {boundary_distance('ex', 'ey')} <= {EPS}) AND NOT ({inside('ax', 'ay')} AND {boundary_distance('ax', 'ay')} > {EPS}) "
    f"AND size(pieces) = 1 AND abs(get(pieces, 0).t - _len) <= {EPS} AND abs(get(pieces, 0).t - get(pieces, 0).f - {boundary_distance('ex', 'ey')}) <= {EPS})"
)
#: The network that a segment joins may be touched at the segment's ends.
_JOINS = f"(size(pieces) > 0 AND NOT exists(pieces, p -> p.t > {EPS} AND p.f < _len - {EPS}) AND distance_m <= {EPS})"


def candidates(segments: DataFrame, obstacles: DataFrame, rule_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of a segment and a part within REACH; and the parts of unknown type, which leave every segment open wherever they are.

    segments: seg_id, ax, ay, ex, ey, dn, width, target (the object that it serves) and tie (the line that it
    joins), null if none.
    """
    ruled = obstacles.join(F.broadcast(rule_rows), "type", "left")  # one row a type
    known, unknown = ruled.where("special is not null"), ruled.where("special is null")
    pairs = measured(_near(segments, known, REACH)).withColumn("required_m", F.expr(rules.axis_clearance("type", "dn", "clearance", "width", "obstacle_width")))
    return pairs, unknown.select("ordinal", "component", "type")


def met(segments: DataFrame, obstacles: DataFrame, rule_rows: DataFrame, found: str, reach: float = REACH) -> DataFrame:
    """seg_id, ordinal, component and found (distance_m or pieces) of the pairs of candidates; those farther apart than reach may be left out.

    What only one figure is asked of carries no more than that takes: neither rules nor what segments and parts are besides.
    """
    known = obstacles.join(F.broadcast(rule_rows.select("type")), "type", "left_semi")  # one row a type
    near = _near(segments.select("seg_id", *S), known.select("ordinal", "component", "polygonal", "edges", *B), reach)
    return measured(near, ["seg_id", "ordinal", "component", found])


def _near(segments: DataFrame, obstacles: DataFrame, reach: float) -> DataFrame:
    """Pairs of a segment and a part whose box the segment comes within reach of, and some more near its corners."""
    wide = reach + EPS
    pairs = near_join(boxed(segments), obstacles, ("_x0", "_y0", "_x1", "_y1"), B, wide, CELL)
    across = f"abs((x0 + x1 - ax - ex) * (ey - ay) - (y0 + y1 - ay - ey) * (ex - ax)) <= (x1 - x0 + 2 * {wide}D) * abs(ey - ay) + (y1 - y0 + 2 * {wide}D) * abs(ex - ax)"
    return pairs.where(across).drop("_x0", "_y0", "_x1", "_y1")


def exempted(pairs: DataFrame) -> DataFrame:
    """Adds exempt: own_approach, own_part (the clearance of other parts of an object that is approached), tie or null."""
    scratch = Scratch(pairs.sparkSession, "exempt")
    marked = pairs.withColumn("_own", F.expr(f"coalesce(ordinal = target, false) AND {_APPROACH}")).withColumn("_tie", F.expr(f"coalesce(ordinal = tie, false) AND {_JOINS}"))
    marked = scratch.keep(marked, "marked")
    approached = marked.where("_own").select("seg_id", "ordinal", F.lit(True).alias("_some")).distinct()
    out = marked.join(approached, ["seg_id", "ordinal"], "left")
    return out.withColumn("exempt", F.expr("CASE WHEN _own THEN 'own_approach' WHEN _tie THEN 'tie' WHEN _some AND distance_m > 0 THEN 'own_part' END")).drop("_own", "_tie", "_some")


#: A special part that a segment keeps less than the clearance from.
_TOO_NEAR = f"special AND exempt IS NULL AND distance_m + {EPS} < required_m"


def events(pairs: DataFrame) -> DataFrame:
    """One row for each piece of a special part that is too near: from_m, to_m, angle, crosses, reason, and the passage zone.

    Zones reach beyond the part by its margin, or as far as its clearance asks at that angle.
    """
    each = pairs.where(f"{_TOO_NEAR} AND distance_m <= {EPS}").withColumn("p", F.explode("pieces"))
    each = each.withColumns({"angle": F.expr(angle_at("p.f")), "crosses": F.expr(crosses("p"))})
    wide = f"greatest(margin, required_m / greatest(sin(radians(angle)), 0.05) + {EPS})"
    each = each.withColumns({"zone_from": F.expr(f"p.f - {wide}"), "zone_to": F.expr(f"p.t + {wide}")})
    reason = (
        f"CASE WHEN NOT crosses OR p.f <= {EPS} OR p.t >= _len - {EPS} THEN 'TOUCH_OVERLAP_OR_INCOMPLETE_CROSSING' WHEN angle + 1e-7 < least_angle THEN 'CROSSING_ANGLE' "
        "WHEN zone_from < 0 OR zone_to > _len THEN 'SPECIAL_PASSAGE_OUTSIDE_SEGMENT' END"
    )
    return each.withColumn("reason", F.expr(reason)).select("seg_id", "ordinal", "component", "type", F.col("p.f").alias("from_m"), F.col("p.t").alias("to_m"), "angle", "crosses", "reason", "zone_from", "zone_to", "k", "_len")


def residual(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """seg_id, ordinal, component, reason: special parts that a segment comes too near to, but for where allowed passages through that very part cover it.

    found: events of the pairs. A passage excuses no part but the one that it leads through. What passages through a part, allowed or not, leave of
    the segment is measured against it (SPECIAL_CLEARANCE_CONFLICT). Other parts that are too near have the first reason of their events, or CLEARANCE.
    """
    one = ["seg_id", "ordinal", "component"]
    passages = found.where("coalesce(reason, '') <> 'TOUCH_OVERLAP_OR_INCOMPLETE_CROSSING'")
    spans = passages.select(F.struct(*one).alias("pair"), F.monotonically_increasing_id().alias("passage"), F.col("zone_from").alias("from_m"), F.col("zone_to").alias("to_m"), F.col("_len").alias("length_m"))
    free = base_intervals(spans, "pair").where("from_m < to_m").select("pair.*", "from_m", "to_m")
    near = pairs.where(_TOO_NEAR)
    part = near.join(free, one)
    (fx, fy), (tx, ty) = ([v.format(m=m) for v in _AT] for m in ("from_m", "to_m"))
    cut = part.selectExpr(*one, "required_m", "edges", "polygonal", f"{fx} AS ax", f"{fy} AS ay", f"{tx} AS ex", f"{ty} AS ey")
    left = cut.withColumn("_len", F.expr("sqrt(pow(ex - ax, 2) + pow(ey - ay, 2))")).where(f"CASE WHEN {inside('ax', 'ay')} THEN 0.0 ELSE {_EDGE_DISTANCE} END + {EPS} < required_m")
    conflict = left.select(*one).distinct().withColumn("reason", F.lit("SPECIAL_CLEARANCE_CONFLICT"))
    judged = found.groupBy(*one).agg(F.min("reason").alias("_why"), F.lit(True).alias("_met"))
    rest = near.join(conflict, one, "left_anti").join(judged, one, "left").where("_why IS NOT NULL OR _met IS NULL")
    return conflict.unionByName(rest.select(*one, F.coalesce("_why", F.lit("CLEARANCE")).alias("reason")))


def decide(segments: DataFrame, obstacles: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """seg_id, status, reasons (distinct, in order): all decisions on segments against parts of any shape."""
    pairs, unknown = candidates(segments, obstacles, rule_rows)
    pairs = exempted(pairs)
    plain = pairs.where(f"exempt IS NULL AND distance_m + {EPS} < required_m AND (NOT special OR distance_m > {EPS})")
    plain = plain.select("seg_id", F.expr("CASE WHEN NOT special AND distance_m <= 0 THEN 'FORBIDDEN_INTERSECTION' ELSE 'CLEARANCE' END").alias("reason"))
    through = events(pairs)
    bad = through.where("reason IS NOT NULL").select("seg_id", "reason")
    conflict = residual(pairs, through).where("reason = 'SPECIAL_CLEARANCE_CONFLICT'").select("seg_id", "reason")
    per = plain.unionByName(bad).unionByName(conflict).groupBy("seg_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    some = F.lit(unknown.count())  # one number
    out = segments.select("seg_id").join(per, "seg_id", "left")
    reasons = F.coalesce("reasons", F.array().cast("array<string>"))
    status = F.when(F.size(reasons) > 0, "BLOCKED").when(some > 0, "INDETERMINATE").otherwise("ALLOWED")
    return out.select("seg_id", status.alias("status"), reasons.alias("reasons"), some.alias("unresolved"))
