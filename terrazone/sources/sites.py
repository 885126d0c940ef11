"""Site loaders: from the published tables of points to numbered points in metres and their observations.

Each returns points (node, point_id, x, y, lon, lat and static columns) and observed (node, t, value). Nodes are numbered
in the order of the identifiers, after the region and the grid have thinned the points and before any value is read.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrazone.functions.columns import stable_id
from terrazone.operators import terrain
from terrazone.sources import geo, readers

#: Metres around an inventory polygon, and width of the grid that keeps one point a cell (fixed values).
BUFFER, CELL = 200.0, 20.0


def numbered(points: DataFrame, observed: DataFrame, key: str = "point_id", most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Node numbers in order of the ids, the first `most` only, and the observations of those points. The ids of one
    site are ordered by one task."""
    if most is not None:
        if most < 1:
            raise ValueError("at least one point")
        points = points.orderBy(key).limit(most)
    points = points.withColumn("node", (F.row_number().over(Window.orderBy(key)) - 1).cast("long"))
    return points, observed.join(points.select(key, "node"), key).select("node", "t", "value")


def read_polygon(spark: SparkSession, path: str, id_field: str, wanted: str) -> list[tuple[float, float]]:
    """Longitude and latitude of the outer ring of the one polygon of a GeoJSON file whose id matches; ids are compared
    without a trailing `.0`."""
    record = json.loads("\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect()))
    plain = lambda v: str(v).strip().removesuffix(".0")
    found = [f["geometry"] for f in record["features"] if plain(f["properties"].get(id_field)) == plain(wanted)]
    if len(found) != 1:
        raise ValueError(f"one polygon with {id_field} = {wanted} is expected, not {len(found)}")
    rings = found[0]["coordinates"][0] if found[0]["type"] == "MultiPolygon" else found[0]["coordinates"]
    ring = [(float(x), float(y)) for x, y, *_ in rings[0]]
    return ring[:-1] if ring[0] == ring[-1] else ring


def _table(spark: SparkSession, path: str, scratch: str | None, member: str) -> str:
    if not path.endswith(".zip"):
        return path
    if not scratch:
        raise ValueError("a zipped table needs a shared folder to be written to once")
    return readers.unzip(spark, path, f"{scratch}/table", member)


def polygon_site(spark: SparkSession, path: str, polygon: list[tuple[float, float]], zone: int, layout: readers.WideFormat = readers.OFFIDA, best: str = "temporal_coherence", scratch: str | None = None, value_scope: str = "all", most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Points with longitude and latitude inside a polygon (longitude, latitude) or near it, one for each grid cell."""
    points, observed = readers.read_wide(spark, _table(spark, path, scratch, r"(?i)\.csv$"), layout, value_scope)
    x, y = terrain.utm(F.col("longitude"), F.col("latitude"), zone)
    points = points.withColumns({"x": x, "y": y, "lon": F.col("longitude"), "lat": F.col("latitude")})
    corners = spark.createDataFrame([(k, *p) for k, p in enumerate(polygon)], "k int, lon double, lat double").select("k", *terrain.utm(F.col("lon"), F.col("lat"), zone)).orderBy("k").collect()
    kept = terrain.inside(points, [(c[1], c[2]) for c in corners], BUFFER)
    kept = terrain.thin(kept.withColumn("id", F.col("point_id")), CELL, best).drop("id", "gx", "gy")
    return numbered(kept, observed, most=most)


def european_site(spark: SparkSession, path: str, zone: int, layout: readers.WideFormat = readers.MENDATICA, scratch: str | None = None, member: str = r"\.csv$", value_scope: str = "all", most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Points on the European equal-area grid, brought to a UTM zone."""
    points, observed = readers.read_wide(spark, _table(spark, path, scratch, member), layout, value_scope)
    lon, lat = terrain.laea_europe(F.col("easting"), F.col("northing"))
    points = points.withColumns({"lon": lon, "lat": lat})
    x, y = terrain.utm(F.col("lon"), F.col("lat"), zone)
    return numbered(points.withColumns({"x": x, "y": y}), observed, most=most)


def shape_site(spark: SparkSession, path: str, zone: int, product: str, layout: readers.WideFormat = readers.ZHOUQU, member: str = "", value_scope: str = "all", most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Points of a zipped shapefile in longitude and latitude; their ids are digests of the product, the feature's number
    and its place."""
    points, observed = geo.read_shapes(spark, path, layout, member, value_scope)
    place = [F.format_string("%.8f", c) for c in ("x", "y")]
    points = points.withColumn("point_id", stable_id("", [F.lit(product), F.col("fid").cast("string"), *place])).withColumnsRenamed({"x": "lon", "y": "lat"})
    x, y = terrain.utm(F.col("lon"), F.col("lat"), zone)
    points = points.withColumns({"x": x, "y": y})
    return numbered(points, observed.join(points.select("fid", "point_id"), "fid"), most=most)


def raster_site(spark: SparkSession, folders: dict[str, str], place: geo.Raster, columns: tuple[str, str], aspect: DataFrame, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Cells of dated component rasters (east, north) that have values at enough dates, projected to the steepest
    descent. aspect: row, col, aspect (degrees). Points are at the cells' centres."""
    from terrazone.operators import audits

    cube = geo.component_cube(spark, folders)
    rows = cube.withColumnRenamed("day", "e")
    supported = audits.support_mask(rows, list(columns)).where("not invalid").select("row", "col")
    kept = audits.joint_validity(rows, list(columns), share).where("kept").select("row", "col").join(supported, ["row", "col"]).join(aspect, ["row", "col"])
    ident = F.format_string("r%06d_c%06d", "row", "col")
    points = kept.select(ident.alias("point_id"), "row", "col", "aspect", (F.lit(place.x0) + (F.col("col") + 0.5) * place.dx).alias("x"), (F.lit(place.y0) - (F.col("row") + 0.5) * place.dy).alias("y"))
    value = audits.downslope(F.col(columns[0]), F.col(columns[1]), F.col("aspect"))
    observed = cube.join(points.select("row", "col", "point_id", "aspect"), ["row", "col"]).select("point_id", F.col("day").cast("timestamp").alias("t"), value.alias("value"))
    return numbered(points, observed)
