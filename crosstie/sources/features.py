"""Features: attributes with a geometry of plain arrays.

At rest a point is two double columns, a line an array of (x, y) structs and a
polygon an array of rings. Interchange is GeoJSON, one feature per line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosstie.geo.shapes import segments_from_points

POINT = "Point"
LINE = "LineString"
POLYGON = "Polygon"
_COORDINATES = {POINT: "array<double>", LINE: "array<array<double>>", POLYGON: "array<array<array<double>>>"}


def _pair(p: Column) -> Column:
    return F.array(p["x"], p["y"])


def _xy(a: Column) -> Column:
    return F.struct(F.get(a, F.lit(0)).alias("x"), F.get(a, F.lit(1)).alias("y"))


def _feature_type(kind: str, properties: str) -> str:
    return (f"struct<type: string, geometry: struct<type: string, coordinates: {_COORDINATES[kind]}>, "
            f"properties: struct<{properties}>>")


def _from_features(df: DataFrame, kind: str) -> DataFrame:
    c = F.col("geometry.coordinates")
    if kind == POINT:
        shape = [F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y")]
    elif kind == LINE:
        shape = [F.transform(c, _xy).alias("points")]
    else:
        shape = [F.transform(c, lambda ring: F.transform(ring, _xy)).alias("rings")]
    return df.select("properties.*", *shape)


def read_geojson(spark: SparkSession, path: str, kind: str, properties: str, collection: bool = False) -> DataFrame:
    """Features to rows. ``properties`` is a struct body such as ``"id: bigint, name: string"``.

    Line-delimited features split over tasks; a single-document collection is read
    whole per file and exploded.
    """
    feature = _feature_type(kind, properties)
    if collection:
        schema = T.DataType.fromDDL(f"struct<features: array<{feature}>>")
        docs = spark.read.schema(schema).option("multiLine", True).json(path)
        return _from_features(docs.select(F.inline("features")), kind)
    return _from_features(spark.read.schema(T.DataType.fromDDL(feature)).json(path), kind)


def feature_text(df: DataFrame, kind: str, properties: Sequence[str]) -> DataFrame:
    """One GeoJSON feature text per row."""
    if kind == POINT:
        coordinates = F.array("x", "y")
    elif kind == LINE:
        coordinates = F.transform("points", _pair)
    else:
        coordinates = F.transform("rings", lambda ring: F.transform(ring, _pair))
    geometry = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"),
                       F.struct(*[F.col(p) for p in properties]).alias("properties"))
    return df.select(F.to_json(feature).alias("value"))


def write_geojson(df: DataFrame, path: str, kind: str, properties: Sequence[str]) -> None:
    feature_text(df, kind, properties).write.mode("overwrite").text(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_features(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def lines_from_vertices(vertices: DataFrame, line: str = "line_id", seq: str = "seq",
                        most_points: int = 10_000) -> DataFrame:
    """Vertices (numbered from 0) to point arrays for export, as ``line, part, first_seq, points``.

    A line of more than ``most_points`` vertices becomes several parts that share their
    end points, so no array grows with the length of a line. ``first_seq`` is the number of
    a part's first vertex; with it ``vertices_from_lines`` and ``segments_from_lines`` give
    back the line's own numbers.
    """
    part = (F.col(seq) / F.lit(most_points)).cast("bigint")
    starts_part = (F.col(seq) > 0) & (F.col(seq) % most_points == 0)
    parts = F.when(starts_part, F.array(part, part - 1)).otherwise(F.array(part))
    pts = F.array_sort(F.collect_list(F.struct(F.col(seq), "x", "y")))
    listed = vertices.withColumn("part", F.explode(parts)).groupBy(line, "part")
    shaped = listed.agg(F.transform(pts, lambda p: F.struct(p["x"], p["y"])).alias("points")).where(F.size("points") > 1)
    return shaped.select(line, "part", (F.col("part") * most_points).alias("first_seq"), "points")


def vertices_from_lines(lines: DataFrame, seq: str = "seq") -> DataFrame:
    """Point arrays in parts back to numbered vertices; a shared end point comes from the part it ends."""
    rest = [c for c in lines.columns if c not in ("part", "first_seq", "points")]
    placed = lines.select(*rest, "first_seq", F.posexplode("points").alias("_i", "_p"))
    return (placed.where((F.col("_i") > 0) | (F.col("first_seq") == 0))
            .select(*rest, (F.col("first_seq") + F.col("_i")).cast("bigint").alias(seq), "_p.x", "_p.y"))


def segments_from_lines(lines: DataFrame) -> DataFrame:
    """Point arrays in parts to segments, numbered through the whole line (``seq``); no shuffle."""
    segments = segments_from_points(lines.drop("part"))
    return segments.withColumn("seq", (F.col("first_seq") + F.col("seq")).cast("bigint")).drop("first_seq")
