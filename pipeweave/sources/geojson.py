"""GeoJSON features: decoding, validation with error rows, and derived measures."""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipeweave.functions import geo

LIMITS = {"members": 1024, "name": 256, "depth": 64, "string": 1 << 20, "number": 128}


def _number(text: str) -> Decimal:
    if len(text) > LIMITS["number"]:
        raise ValueError("number too long")
    return Decimal(text)


def _members(pairs: list) -> dict:
    """An object whose members are few, of short names and different."""
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("duplicate member")
    if len(out) > LIMITS["members"] or any(len(k) > LIMITS["name"] for k in out):
        raise ValueError("too many or too long members")
    return out


def _decode(text: str):
    try:
        value = json.loads(text, parse_int=_number, parse_float=_number, parse_constant=lambda x: (_ for _ in ()).throw(ValueError(x)), object_pairs_hook=_members)
    except RecursionError:
        raise ValueError("too deep") from None
    _guard(value)
    return value


def _guard(value) -> None:
    """Objects and arrays are not nested too deep, and strings not too long."""
    todo = [(value, 1)]
    while todo:
        x, depth = todo.pop()
        if isinstance(x, str) and len(x.encode("utf-8", "surrogatepass")) > LIMITS["string"]:
            raise ValueError("string too long")
        if isinstance(x, (dict, list)):
            if depth > LIMITS["depth"]:
                raise ValueError("too deep")
            todo += [(y, depth + 1) for y in (x.values() if isinstance(x, dict) else x)]


def _canonical(value) -> tuple[str | None, str | None]:
    """An id as canonical JSON and as a typed key; numbers lose zeros that say nothing, strings stay strings."""
    if isinstance(value, Decimal):
        if abs(value.as_tuple().exponent) > 1000:
            return None, None
        plain = f"{value:f}"
        plain = plain.rstrip("0").rstrip(".") if "." in plain else plain
        plain = plain if value else "0"
        return plain, f"n:{plain}"
    return (json.dumps(value, ensure_ascii=False), f"s:{value}") if isinstance(value, str) else (None, None)


def canonical_ids(df: DataFrame, column: str) -> DataFrame:
    """df with id_json and id_key of a column that holds JSON scalars; null for what is no id."""

    @F.pandas_udf("struct<id_json:string,id_key:string>")
    def ids(raw: pd.Series) -> pd.DataFrame:
        out = []
        for x in raw:
            try:
                out.append(_canonical(_decode(x)) if x is not None else (None, None))
            except ValueError:
                out.append((None, None))
        return pd.DataFrame(out, columns=["id_json", "id_key"])

    return df.withColumn("_id", ids(column)).select("*", "_id.*").drop("_id")


def _features(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each line's members as columns; error says why a line is no feature at all."""
    for part in rows:
        out = []
        for ordinal, line in zip(part["ordinal"], part["line"], strict=True):
            try:
                f = _decode(line)
                p, g = f.get("properties") or {}, f.get("geometry") or {}
                number = lambda k, p=p: float(p[k]) if isinstance(p.get(k), Decimal) else None
                whole = isinstance(p.get("diameter"), Decimal) and p["diameter"] == p["diameter"].to_integral_value()
                out.append((ordinal, f.get("type"), *_canonical(p.get("id")), p.get("object_type"), p.get("restriction_type"), number("diameter"), whole, number("flow_tph"), g.get("type"), json.dumps(g.get("coordinates"), default=float), None))
            except (ValueError, AttributeError, RecursionError) as e:
                out.append((ordinal, *[None] * 6, False, *[None] * 3, str(e)[:200] or "not a feature"))
        yield pd.DataFrame(out, columns="ordinal type id_json id_key object_type restriction_type diameter whole flow_tph geometry coordinates error".split())


def decode(lines: DataFrame) -> DataFrame:
    """lines: ordinal, line (one feature each)."""
    kind = "ordinal long, type string, id_json string, id_key string, object_type string, restriction_type string, diameter double, whole boolean, flow_tph double, geometry string, coordinates string, error string"
    return lines.select("ordinal", "line").mapInPandas(_features, kind)


def _sound(points: str) -> str:
    return f"size({points}) > 0 AND forall({points}, p -> size(p) BETWEEN 2 AND 3 AND p[0] BETWEEN -180 AND 180 AND p[1] BETWEEN -90 AND 90 AND forall(p, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity')))"


_RING = "size(r) >= 4 AND r[0] = element_at(r, -1) AND " + _sound("r")
_GEOMETRY_OK = f"""CASE geometry WHEN 'Point' THEN {_sound("array(from_json(coordinates, 'array<double>'))")}
    WHEN 'LineString' THEN size(from_json(coordinates, 'array<array<double>>')) >= 2 AND {_sound("from_json(coordinates, 'array<array<double>>')")}
    WHEN 'MultiLineString' THEN size(from_json(coordinates, 'array<array<array<double>>>')) > 0 AND forall(from_json(coordinates, 'array<array<array<double>>>'), r -> size(r) >= 2 AND {_sound("r")})
    WHEN 'Polygon' THEN size(from_json(coordinates, 'array<array<array<double>>>')) > 0 AND forall(from_json(coordinates, 'array<array<array<double>>>'), r -> {_RING})
    WHEN 'MultiPolygon' THEN size(from_json(coordinates, 'array<array<array<array<double>>>>')) > 0 AND forall(from_json(coordinates, 'array<array<array<array<double>>>>'), g -> size(g) > 0 AND forall(g, r -> {_RING})) ELSE FALSE END"""
# Which geometry each object type takes.
_SHAPE_OK = """CASE WHEN object_type IN ('source', 'heat_chamber', 'oks_connection_point') THEN geometry = 'Point' WHEN object_type = 'heat_network' THEN geometry = 'LineString'
    WHEN object_type = 'restriction' THEN geometry IN ('LineString', 'MultiLineString', 'Polygon', 'MultiPolygon') ELSE FALSE END"""


def validate(features: DataFrame) -> DataFrame:
    """features with the path of the first thing that is wrong in error_path, null if nothing is."""
    wrong = (
        F.when(F.col("error").isNotNull(), "$")
        .when(F.expr("coalesce(type, '') <> 'Feature'"), "$.type")
        .when(F.col("id_key").isNull(), "$.properties.id")
        .when(F.expr(f"NOT coalesce({_SHAPE_OK}, FALSE)"), "$.geometry.type")
        .when(F.expr("object_type = 'restriction' AND trim(coalesce(restriction_type, '')) = ''"), "$.properties.restriction_type")
        .when(F.expr("object_type = 'heat_network' AND NOT coalesce(whole AND diameter > 0, FALSE)"), "$.properties.diameter")
        .when(F.expr("object_type = 'oks_connection_point' AND NOT coalesce(flow_tph >= 0, FALSE)"), "$.properties.flow_tph")
        .when(F.expr(f"NOT coalesce({_GEOMETRY_OK}, FALSE)"), "$.geometry.coordinates")
    )
    return features.withColumn("error_path", wrong)


def duplicates(features: DataFrame) -> DataFrame:
    """Ids that more than one feature has."""
    return features.where("id_key IS NOT NULL").groupBy("id_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Features of a newline-delimited file, numbered from 0 in the order of the file.

    A line's place comes from its file's order and its offset, so numbering is the same in every run.
    """
    lines = spark.read.text(path).where("trim(value) <> ''").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    counts = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    from pyspark.sql import Window

    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("file", "block", "first", before.alias("before"))  # one row a split
    return lines.join(starts, ["file", "block"]).select((F.col("at") - F.col("first") + F.col("before")).alias("ordinal"), F.col("value").alias("line"))


def projected(features: DataFrame) -> DataFrame:
    """Vertices of sound points and lines in metres: ordinal, i, easting, northing."""
    points = F.when(F.col("geometry") == "Point", F.array(F.from_json("coordinates", "array<double>"))).otherwise(F.from_json("coordinates", "array<array<double>>"))
    sound = features.where("error_path IS NULL AND geometry IN ('Point', 'LineString')").select("ordinal", F.posexplode(points).alias("i", "p"))
    at = sound.select("ordinal", "i", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))
    e, n = geo.utm("lon", "lat")
    return at.select("ordinal", "i", F.expr(e).alias("easting"), F.expr(n).alias("northing"))
