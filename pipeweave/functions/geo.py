"""Plane geometry and the UTM projection as SQL text over column names.

Points are (x, y) in metres; a segment is named by a prefix pair such as ("ax", "ay", "ex", "ey").
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

Segment = tuple[str, str, str, str]


def length(s: Segment) -> str:
    ax, ay, bx, by = s
    return f"sqrt(({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}))"


def distance(p: tuple[str, str], q: tuple[str, str]) -> str:
    return length((*p, *q))


def locate(p: tuple[str, str], s: Segment) -> str:
    """Where on the segment, from 0 to 1, the point nearest to p lies; 0 on a segment without length."""
    (px, py), (ax, ay, bx, by) = p, s
    dot = f"(({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay}))"
    square = f"(({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}))"
    return f"coalesce(least(1.0, greatest(0.0, {dot} / nullif({square}, 0.0))), 0.0)"


def point_segment(p: tuple[str, str], s: Segment) -> str:
    t, (ax, ay, bx, by) = locate(p, s), s
    return distance(p, (f"({ax} + {t} * ({bx} - {ax}))", f"({ay} + {t} * ({by} - {ay}))"))


def point_box(p: tuple[str, str], box: Segment) -> str:
    (px, py), (x0, y0, x1, y1) = p, box
    dx, dy = (f"greatest({lo} - {v}, 0.0, {v} - {hi})" for v, lo, hi in ((px, x0, x1), (py, y0, y1)))
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


def _clip(a: str, b: str, lo: str, hi: str, last: bool) -> str:
    """Where the segment enters (or leaves) the strip lo..hi of one axis; an empty range if it never does."""
    one, two = f"({lo} - {a}) / nullif({b} - {a}, 0.0)", f"({hi} - {a}) / nullif({b} - {a}, 0.0)"
    pick = f"greatest({one}, {two})" if last else f"least({one}, {two})"
    none = ("-1.0", "2.0") if last else ("2.0", "-1.0")
    return f"(CASE WHEN {b} <> {a} THEN {pick} WHEN {a} < {lo} OR {a} > {hi} THEN {none[0]} ELSE {none[1]} END)"


def enters(s: Segment, box: Segment) -> str:
    (ax, ay, bx, by), (x0, y0, x1, y1) = s, box
    return f"greatest(0.0, {_clip(ax, bx, x0, x1, False)}, {_clip(ay, by, y0, y1, False)})"


def leaves(s: Segment, box: Segment) -> str:
    (ax, ay, bx, by), (x0, y0, x1, y1) = s, box
    return f"least(1.0, {_clip(ax, bx, x0, x1, True)}, {_clip(ay, by, y0, y1, True)})"


def segment_box(s: Segment, box: Segment) -> str:
    """0 if they meet, else the least distance."""
    (ax, ay, bx, by), (x0, y0, x1, y1) = s, box
    corners = ", ".join(point_segment(c, s) for c in ((x0, y0), (x0, y1), (x1, y0), (x1, y1)))
    return f"(CASE WHEN {enters(s, box)} <= {leaves(s, box)} THEN 0.0 ELSE least({point_box((ax, ay), box)}, {point_box((bx, by), box)}, {corners}) END)"


def box_angle(s: Segment, box: Segment) -> str:
    """The angle in degrees, 0 to 90, between the segment and the side of the box by which it enters."""
    (ax, ay, bx, by), (x0, y0, x1, y1) = s, box
    ex, ey = _clip(ax, bx, x0, x1, False), _clip(ay, by, y0, y1, False)
    by_x, by_y = (f"degrees(acos(least(1.0, abs({v}) / {length(s)})))" for v in (f"{by} - {ay}", f"{bx} - {ax}"))
    return f"(CASE WHEN {ex} > {ey} THEN {by_x} WHEN {ex} < {ey} THEN {by_y} ELSE least({by_x}, {by_y}) END)"


def cross(s: Segment, t: Segment) -> str:
    (ax, ay, bx, by), (cx, cy, dx, dy) = s, t
    return f"(({bx} - {ax}) * ({dy} - {cy}) - ({by} - {ay}) * ({dx} - {cx}))"


def meets_at(s: Segment, t: Segment) -> str:
    """Where on s, in parts of its length, the line of t cuts it; null for parallels."""
    (ax, ay, _, _), (cx, cy, dx, dy) = s, t
    return f"((({cx} - {ax}) * ({dy} - {cy}) - ({cy} - {ay}) * ({dx} - {cx})) / nullif({cross(s, t)}, 0.0))"


def lines_angle(s: Segment, t: Segment) -> str:
    (ax, ay, bx, by), (cx, cy, dx, dy) = s, t
    dot = f"(({bx} - {ax}) * ({dx} - {cx}) + ({by} - {ay}) * ({dy} - {cy}))"
    return f"degrees(acos(least(1.0, abs({dot}) / ({length(s)} * {length(t)}))))"


def side(p: tuple[str, str], s: Segment) -> str:
    """Signed distance of p from the line of s."""
    (px, py), (ax, ay, bx, by) = p, s
    return f"((({bx} - {ax}) * ({py} - {ay}) - ({by} - {ay}) * ({px} - {ax})) / {length(s)})"


# The WGS 84 ellipsoid and UTM zone 37 north.
_A, _F, _K0, _E0, _L0 = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 39.0
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Krueger's series to the fourth order.
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)
_E = 2 * sqrt(_N) / (1 + _N)


def _atanh(x: str) -> str:
    return f"(0.5 * ln((1.0 + {x}) / (1.0 - {x})))"


def utm(lon: str, lat: str) -> tuple[str, str]:
    """Easting and northing of degrees, as SQL text."""
    sin = f"sin(radians({lat}))"
    t = f"sinh({_atanh(sin)} - {_E!r} * {_atanh(f'({_E!r} * {sin})')})"
    turn = f"radians({lon} - {_L0!r})"
    xi, eta = f"atan2({t}, cos({turn}))", _atanh(f"(sin({turn}) / sqrt(1.0 + {t} * {t}))")
    east = " + ".join([eta, *(f"{a!r} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, a in enumerate(_ALPHA, 1))])
    north = " + ".join([xi, *(f"{a!r} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate(_ALPHA, 1))])
    return f"({_E0!r} + {_K0 * _RADIUS!r} * ({east}))", f"({_K0 * _RADIUS!r} * ({north}))"


def wgs84(x: str, y: str) -> tuple[str, str]:
    """Longitude and latitude in degrees of an easting and northing, as SQL text."""
    xi, eta = f"({y} / {_K0 * _RADIUS!r})", f"(({x} - {_E0!r}) / {_K0 * _RADIUS!r})"
    xi0 = f"({xi} - ({' + '.join(f'{b!r} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})' for j, b in enumerate(_BETA, 1))}))"
    eta0 = f"({eta} - ({' + '.join(f'{b!r} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})' for j, b in enumerate(_BETA, 1))}))"
    chi = f"asin(sin({xi0}) / cosh({eta0}))"
    lat = f"({chi} + {' + '.join(f'{d!r} * sin({2 * j} * {chi})' for j, d in enumerate(_DELTA, 1))})"
    return f"({_L0!r} + degrees(atan2(sinh({eta0}), cos({xi0}))))", f"degrees({lat})"


def cells(x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> Column:
    """All grid cells, as structs of i and j, that a box touches."""
    at = lambda v: F.floor(v / size)
    rows = F.sequence(at(y0), at(y1))
    return F.flatten(F.transform(F.sequence(at(x0), at(x1)), lambda i: F.transform(rows, lambda j: F.struct(i.alias("i"), j.alias("j")))))


