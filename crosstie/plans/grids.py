"""Analysis grids along corridors and area layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstie.geo.hexgrid import hex_cells, mark_cut_cells
from crosstie.geo.polygons import polygons_with_points
from crosstie.sources import features

# Corridor width on each side, strip around the line and cell width, in metres.
CORRIDOR_DISTANCE = 8047.0
STRIP = 20.0
CELL_WIDTH = 1609.0 * 3


def analysis_grid(rail: DataFrame, distance: float = CORRIDOR_DISTANCE, width: float = CELL_WIDTH,
                  strip: float = STRIP, corridor: str = "rail_corridor") -> DataFrame:
    """Cells around each corridor with a stable id, marked where the line cuts them."""
    lines = rail.where(F.col(corridor).isNotNull())
    cells = mark_cut_cells(hex_cells(lines, distance, width, [corridor]), lines, strip, distance, width, [corridor])
    label = F.concat_ws("_", F.col("row").cast("string"), F.col("cell").cast("string"))
    return cells.withColumns({"id": label, "name": label, "is_pass": F.lit(0)})


def corridor_polygons(polygons: DataFrame, edges: DataFrame, assets: DataFrame) -> DataFrame:
    """Areas holding at least one asset of the corridor."""
    return polygons_with_points(polygons, edges, assets)


def export_parcels(spark: SparkSession, source: str, target: str, properties: Sequence[str]) -> None:
    """Stored polygon features to GeoJSON lines."""
    features.write_geojson(features.read_features(spark, source), target, features.POLYGON, properties)
