"""Rasters, point shapes and composites from their files: GeoTIFF, zipped elevation models, zipped shapefiles, NetCDF.

No geographic library is needed: the parts of the formats that point and raster products use are decoded here, one
file a task. What comes out are the long tables that the operators read.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazone.operators import terrain
from terrazone.sources.readers import WideFormat, dated, header_dates

# GeoTIFF ----------------------------------------------------------------------------------------------------------

#: TIFF tags and types that are read (fixed values of the format).
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, ROWS_PER_STRIP, STRIP_BYTES, PREDICTOR = 256, 257, 258, 259, 273, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, SAMPLE_FORMAT, SAMPLES = 322, 323, 324, 325, 339, 277
PIXEL_SCALE, TIE_POINT, GEO_KEYS, NODATA = 33550, 33922, 34735, 42113
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
_KINDS = {1: "u", 2: "i", 3: "f"}
#: Keys of a geographic and a projected system in the directory of GeoTIFF keys.
_GEOGRAPHIC, _PROJECTED = 2048, 3072


@dataclass(frozen=True)
class Raster:
    """Cells (row 0 at the top; missing ones NaN), the upper left corner, cell sizes, and the EPSG code or None."""

    z: np.ndarray
    x0: float
    y0: float
    dx: float
    dy: float
    epsg: int | None
    geographic: bool


def decode_tiff(raw: bytes) -> Raster:
    """The first band of a classic or big TIFF: strips or tiles, plain or deflated, with or without a predictor."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None:
        raise ValueError("not a TIFF file")
    big = struct.unpack_from(order + "H", raw, 2)[0] == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), raw, 8 if big else 4)[0]
    count = struct.unpack_from(order + ("Q" if big else "H"), raw, at)[0]
    entry, head, room, number = (20, 8, 8, "Q") if big else (12, 2, 4, "I")
    tags: dict[int, tuple] = {}
    for k in range(count):
        place = at + head + k * entry
        tag, kind, n = struct.unpack_from(f"{order}HH{number}", raw, place)
        if kind not in _TYPES:
            continue
        code = f"{order}{n}{_TYPES[kind]}"
        inline = place + entry - room
        start = inline if struct.calcsize(code) <= room else struct.unpack_from(order + number, raw, inline)[0]
        tags[tag] = struct.unpack_from(code, raw, start)
    width, height, samples = tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, (1,))[0]
    kind = np.dtype(f"{order}{_KINDS[tags.get(SAMPLE_FORMAT, (1,))[0]]}{tags[BITS][0] // 8}")
    compression, predictor = tags.get(COMPRESSION, (1,))[0], tags.get(PREDICTOR, (1,))[0]
    if compression not in (1, 8, 32946) or predictor not in (1, 2, 3):
        raise ValueError(f"compression {compression} with predictor {predictor} is not read")
    if TILES in tags:
        w, h, places, sizes = tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0], tags[TILES], tags[TILE_BYTES]
    else:
        w, h, places, sizes = width, min(height, tags.get(ROWS_PER_STRIP, (height,))[0]), tags[STRIPS], tags[STRIP_BYTES]
    across = -(-width // w)
    z = np.empty((height, width))
    for k in range(across * -(-height // h)):  # further bands follow the first or share its cells
        top, left = k // across * h, k % across * w
        part = raw[places[k] : places[k] + sizes[k]]
        block = _unfiltered(zlib.decompress(part) if compression != 1 else part, kind, w, h if TILES in tags else min(h, height - top), samples if tags.get(284, (1,))[0] == 1 else 1, predictor)
        z[top : top + h, left : left + w] = block[: height - top, : width - left]
    if NODATA in tags:
        text = tags[NODATA][0].split(b"\0")[0].strip()
        if text and text.lower() != b"nan":
            z[np.isclose(z, float(text))] = np.nan
    z[~np.isfinite(z)] = np.nan
    sx, sy = tags.get(PIXEL_SCALE, (1.0, 1.0, 0.0))[:2]
    column, row, _, x, y, _ = tags.get(TIE_POINT, (0.0, 0.0, 0.0, 0.0, float(height) * sy, 0.0))[:6]
    keys = tags.get(GEO_KEYS, ())
    codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    return Raster(z, x - column * sx, y + row * sy, sx, sy, codes.get(_PROJECTED, codes.get(_GEOGRAPHIC)), _PROJECTED not in codes and _GEOGRAPHIC in codes)


def _unfiltered(part: bytes, kind: np.dtype, width: int, height: int, samples: int, predictor: int) -> np.ndarray:
    if predictor == 3:  # bytes of a line's numbers by significance, as differences
        lines = np.cumsum(np.frombuffer(part, np.uint8)[: height * width * samples * kind.itemsize].reshape(height, -1, samples), axis=1, dtype=np.uint8)
        cells = lines.reshape(height, kind.itemsize, width * samples).transpose(0, 2, 1)
        return np.ascontiguousarray(cells).view(kind.newbyteorder(">")).reshape(height, width, samples)[:, :, 0].astype(float)
    cells = np.frombuffer(part, kind, height * width * samples).reshape(height, width, samples)
    if predictor == 2:
        cells = np.cumsum(cells, axis=1, dtype=kind)
    return cells[:, :, 0].astype(float)


def dem_member(names: list[str], hint: str | None = None) -> str:
    """The first GeoTIFF of an archive by name; of those that contain the hint, if any does."""
    found = sorted(n for n in names if n.lower().endswith((".tif", ".tiff")))
    if not found:
        raise FileNotFoundError("the archive holds no GeoTIFF")
    return next((n for n in found if hint and hint in n), found[0])


def open_dem(spark: SparkSession, path: str, hint: str | None = None) -> tuple[DataFrame, Raster]:
    """row, col, z of an elevation model, a GeoTIFF or a zip file with some; and its place without the cells.

    One file is one raster, so its bytes are read by one task; the place comes back as one row.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def raster(name: str, raw: bytes) -> Raster:
        if name.lower().endswith(".zip"):
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                raw = z.read(dem_member(z.namelist(), hint))
        return decode_tiff(raw)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                r = raster(name, bytes(raw))
                yield pd.DataFrame({"x0": [r.x0], "y0": [r.y0], "dx": [r.dx], "dy": [r.dy], "epsg": [r.epsg], "geographic": [r.geographic], "rows": [r.z.shape[0]], "cols": [r.z.shape[1]], "known": [int(np.isfinite(r.z).sum())]})

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                z = raster(name, bytes(raw)).z
                for lo in range(0, z.shape[0], 512):
                    part = z[lo : lo + 512]
                    r, c = np.divmod(np.arange(part.size), z.shape[1])
                    yield pd.DataFrame({"row": r + lo, "col": c, "z": np.where(np.isfinite(part.ravel()), part.ravel(), None)})

    found = files.mapInPandas(place, "x0 double, y0 double, dx double, dy double, epsg int, geographic boolean, rows long, cols long, known long").collect()
    if len(found) != 1:
        raise ValueError(f"one elevation model is expected, not {len(found)}")
    p = found[0]
    if not p.known:
        raise ValueError("the elevation model has no finite cell")
    return files.mapInPandas(cells, "row long, col long, z double"), Raster(np.empty((p.rows, p.cols)), p.x0, p.y0, p.dx, p.dy, p.epsg, p.geographic)


def site_terrain(spark: SparkSession, path: str, points: DataFrame, hint: str | None = None) -> DataFrame:
    """Adds elevation, slope, aspect, curvature and tri to points (node, lon, lat): gaps are filled from the nearest
    cell, derivatives are taken in metres, and each point reads its cell."""
    raster, place = open_dem(spark, path, hint)
    dx, dy = place.dx, place.dy
    if place.geographic:
        dx, dy = terrain.cell_metres(dx, dy, place.y0 - place.z.shape[0] * place.dy / 2)
        at = points.withColumns({"x": F.col("lon"), "y": F.col("lat")})
    elif place.epsg and 32601 <= place.epsg <= 32660:
        x, y = terrain.utm(F.col("lon"), F.col("lat"), place.epsg - 32600)
        at = points.withColumns({"x": x, "y": y})
    else:
        raise ValueError(f"an elevation model in EPSG {place.epsg} is not read")
    cells = terrain.derived(terrain.fill_nearest(raster), dx, dy).withColumnRenamed("z", "elevation")
    found = terrain.sample(at.select("node", "x", "y"), cells, place.x0, place.y0, place.dx, place.dy)
    return points.join(found.select("node", "elevation", "slope", "aspect", "curvature", "tri"), "node")


def read_geotiffs(spark: SparkSession, path: str) -> DataFrame:
    """day, row, col, value of a folder of dated GeoTIFFs."""
    from terrazone.sources.readers import read_raster_series

    return read_raster_series(spark, path, lambda raw: decode_tiff(raw).z)


def component_cube(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """day, row, col and a column for each component, for the days that all folders have."""
    out = None
    for name, path in folders.items():
        own = read_geotiffs(spark, path).withColumnRenamed("value", name)
        out = own if out is None else out.join(own, ["day", "row", "col"])
    if out is None:
        raise ValueError("no component")
    return out


# shapefiles -------------------------------------------------------------------------------------------------------


def decode_dbf(raw: bytes, columns: list[str] | None = None) -> dict[str, list[str]]:
    """Columns of a dBASE table as trimmed text, deleted rows included; `columns` prunes them."""
    rows, head, size = struct.unpack_from("<IHH", raw, 4)
    names, place, at = [], {}, 1
    for k in range((head - 33) // 32):
        field = raw[32 + 32 * k : 64 + 32 * k]
        name = field[:11].split(b"\0")[0].decode("ascii")
        names.append(name)
        place[name] = (at, at + field[16])
        at += field[16]
    table = np.frombuffer(raw, np.uint8, rows * size, head).reshape(rows, size)
    text = lambda a, b: [x.decode("latin-1").strip() for x in np.ascontiguousarray(table[:, a:b]).view(f"S{b - a}").ravel().tolist()]
    return {n: text(*place[n]) for n in names if columns is None or n in columns}


def decode_points(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """x and y of a shapefile of points, with or without heights or measures; other shapes are NaN."""
    x, y, at = [], [], 100
    while at + 12 <= len(raw):
        words = struct.unpack_from(">I", raw, at + 4)[0]
        kind = struct.unpack_from("<I", raw, at + 8)[0]
        px, py = struct.unpack_from("<dd", raw, at + 12) if kind in (1, 11, 21) else (np.nan, np.nan)
        x.append(px)
        y.append(py)
        at += 8 + 2 * words
    return np.array(x), np.array(y)


def shape_files(raw: bytes, member: str) -> dict[str, bytes]:
    """Suffix to bytes of the parts of the shapefile whose path matches, in a zip file and the archives inside it."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = sorted(z.namelist())
        shapes = [n for n in names if n.lower().endswith(".shp") and re.search(member, n)]
        if shapes:
            stem = shapes[0][:-4]
            return {n[-4:].lower(): z.read(n) for n in names if n[:-4] == stem}
        for n in names:
            if n.lower().endswith(".zip") and (found := shape_files(z.read(n), member)):
                return found
    return {}


def read_shapes(spark: SparkSession, path: str, layout: WideFormat, member: str = "", value_scope: str = "all") -> tuple[DataFrame, DataFrame]:
    """points (fid, x, y and static columns) and observed (fid, t, value) of a zipped shapefile of points with a column
    for each date. Only dates inside the layout's window are decoded, and with train_only only the training prefix."""
    files = spark.read.format("binaryFile").load(path).select("content")
    wanted = [c for c in layout.static if c not in ("x", "y")]

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for raw in pdf["content"]:
                found = shape_files(bytes(raw), member)
                yield pd.DataFrame({"name": list(decode_dbf(found[".dbf"][:32] if not found else found[".dbf"], None)) if found else []})

    columns = [r.name for r in files.mapInPandas(names, "name string").collect()]
    if not columns:
        raise ValueError("the archive holds no shapefile with a table")
    dates = header_dates(columns, layout, value_scope)
    kept = [*(c for c in wanted if c in columns), *dates]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for raw in pdf["content"]:
                if found := shape_files(bytes(raw), member):
                    x, y = decode_points(found[".shp"])
                    table = decode_dbf(found[".dbf"], kept)
                    yield pd.DataFrame({"fid": np.arange(len(x)), "x": x, "y": y, **{c: pd.to_numeric(pd.Series(table[c]), errors="coerce") for c in kept}})

    wide = files.mapInPandas(rows, ", ".join(["fid long, x double, y double", *(f"`{c}` double" for c in kept)]))
    value = lambda c: F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`"))
    points = wide.select("fid", "x", "y", *[value(c).alias(c) for c in kept if c not in dates])
    cells = F.explode(F.array(*[F.struct(F.lit(t.to_pydatetime()).alias("t"), value(c).alias("value")) for c, t in dates.items()])).alias("c")
    return points, wide.select("fid", cells).select("fid", "c.t", "c.value")


# NetCDF -----------------------------------------------------------------------------------------------------------

_NC_TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}


def decode_netcdf(raw: bytes, names: list[str]) -> dict[str, np.ndarray]:
    """Variables of a classic NetCDF file (versions 1, 2 and 5), scaled and with fill values as NaN."""
    if raw[:3] != b"CDF" or raw[3] not in (1, 2, 5):
        raise ValueError("a classic NetCDF file is expected; convert newer ones first")
    version, at = raw[3], 4
    wide = version == 5

    def number(long: bool = False) -> int:
        nonlocal at
        size = 8 if long else 4
        at += size
        return int.from_bytes(raw[at - size : at], "big")

    def name() -> str:
        nonlocal at
        n = number(wide)
        text = raw[at : at + n].decode("utf-8")
        at += -(-n // 4) * 4
        return text

    def values() -> np.ndarray:
        nonlocal at
        kind = np.dtype(_NC_TYPES[number()])
        n = number(wide)
        out = np.frombuffer(raw, kind, n, at)
        at += -(-n * kind.itemsize // 4) * 4
        return out

    def listed(item) -> list:
        number()
        return [item() for _ in range(number(wide))]

    records = number(wide)
    sizes = listed(lambda: (name(), number(wide)))
    listed(lambda: (name(), values()))

    def variable() -> tuple:
        key, dims = name(), [number(wide) for _ in range(number(wide))]
        facts = dict(listed(lambda: (name(), values())))
        return key, dims, facts, number(), number(wide), number(version > 1)

    found = listed(variable)
    growing = [v for v in found if v[1] and sizes[v[1][0]][1] == 0]
    step = sum(v[4] for v in growing) if len(growing) != 1 else None
    out = {}
    for key, dims, facts, kind, _, begin in found:
        if key not in names:
            continue
        shape = [sizes[d][1] for d in dims]
        dtype = np.dtype(_NC_TYPES[kind])
        if shape and shape[0] == 0:
            one = int(np.prod(shape[1:], dtype=int))
            width = step if step is not None else one * dtype.itemsize
            x = np.stack([np.frombuffer(raw, dtype, one, begin + r * width).reshape(shape[1:]) for r in range(records)]) if records else np.zeros((0, *shape[1:]), dtype)
        else:
            x = np.frombuffer(raw, dtype, int(np.prod(shape, dtype=int)), begin).reshape(shape)
        if dtype.kind in "iuf":
            x = x.astype(float)
            for fill in ("_FillValue", "missing_value"):
                if fill in facts and np.isfinite(facts[fill][0]):
                    x = np.where(x == float(facts[fill][0]), np.nan, x)
            x = x * float(facts.get("scale_factor", [1.0])[0]) + float(facts.get("add_offset", [0.0])[0])
        out[key] = x
    if missing := sorted(set(names) - set(out)):
        raise ValueError(f"the file lacks {missing}")
    return out


#: Variables of a composite product (fixed values).
COMPOSITE = ["NDVI", "NDMI", "BSI", "valid_proportion", "t", "x", "y"]


def read_composites(spark: SparkSession, path: str, points: DataFrame) -> DataFrame:
    """node, t (as stored), ndvi, ndmi, bsi, valid: each point (node, x, y) reads the nearest cell of a product with the
    variables of COMPOSITE on (t, y, x); a missing share of valid scenes is 0, others are clipped to [0, 1]."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for raw in pdf["content"]:
                v = decode_netcdf(bytes(raw), COMPOSITE)
                for k, t in enumerate(v["t"]):
                    y, x = (a.ravel() for a in np.meshgrid(v["y"], v["x"], indexing="ij"))
                    own = {n.lower(): v[n][k].ravel() for n in ("NDVI", "NDMI", "BSI")}
                    own = {n: np.where(np.isfinite(a), a, None) for n, a in own.items()}
                    yield pd.DataFrame({"t": t, "y": y, "x": x, **own, "valid": np.clip(np.nan_to_num(v["valid_proportion"][k].ravel(), nan=0.0), 0.0, 1.0)})

    files = spark.read.format("binaryFile").load(path).select("content")
    grid = files.mapInPandas(cells, "t double, y double, x double, ndvi double, ndmi double, bsi double, valid double")
    at = terrain.nearest_axis(points.select("node", "x", "y"), grid.select("x").distinct(), "x", "x", "cx")
    at = terrain.nearest_axis(at, grid.select("y").distinct(), "y", "y", "cy")
    return at.select("node", "cx", "cy").join(grid, (F.col("cx") == F.col("x")) & (F.col("cy") == F.col("y"))).select("node", "t", "ndvi", "ndmi", "bsi", "valid")


def composite_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length and day (null without one) of the NetCDF files below a folder, by name; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.nc").load(path).select("path", "length")
    return files.join(dated(files).select("path", "day"), "path", "left").orderBy("path")
