"""Rasters as long tables (row, col, z): derivatives by neighbours, sampling, points in polygons."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def gradient(rows: DataFrame, value: str, across: str, along: str, step: float, name: str) -> DataFrame:
    """Adds a derivative along an axis: central differences, one-sided at the borders. Windows run over one line of the
    raster each."""
    w = Window.partitionBy(across).orderBy(along)
    a, b, x = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    return rows.withColumn(name, F.when(a.isNull(), (b - x) / step).when(b.isNull(), (x - a) / step).otherwise((b - a) / (2 * step)))


def derived(raster: DataFrame, dx: float, dy: float) -> DataFrame:
    """row, col, z, slope and aspect (degrees), curvature, tri (population deviation of the 3 by 3 block, border cells
    repeated)."""
    rows = gradient(gradient(raster, "z", "row", "col", dx, "gx"), "z", "col", "row", dy, "gy")
    rows = gradient(gradient(rows, "gx", "row", "col", dx, "gxx"), "gy", "col", "row", dy, "gyy")
    line, column = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")

    def three(x: Column, w) -> Column:
        return x + F.coalesce(F.lag(x).over(w), x) + F.coalesce(F.lead(x).over(w), x)

    rows = rows.withColumns({"_s": three(F.col("z"), line), "_q": three(F.col("z") * F.col("z"), line)})
    rows = rows.withColumns({"_s": three(F.col("_s"), column) / 9, "_q": three(F.col("_q"), column) / 9})
    return rows.select(
        "row", "col", "z", F.degrees(F.atan(F.hypot("gx", "gy"))).alias("slope"), F.pmod(F.degrees(F.atan2(-F.col("gx"), -F.col("gy"))) + 360, F.lit(360.0)).alias("aspect"),
        (F.col("gxx") + F.col("gyy")).alias("curvature"), F.sqrt(F.greatest(F.col("_q") - F.col("_s") * F.col("_s"), F.lit(0.0))).alias("tri"),
    )


def cell_metres(dx: float, dy: float, latitude: float) -> tuple[float, float]:
    """Metres of a geographic cell at a latitude."""
    return abs(dx) * 111_320.0 * math.cos(math.radians(latitude)), abs(dy) * 110_574.0


def fill_nearest(raster: DataFrame, most: int = 1 << 30) -> DataFrame:
    """Cells without z take that of the nearest cell with one (Euclid, ties to the lower row and column): rings of
    doubling width are searched, so only unfilled cells meet their surroundings."""
    known, gaps = raster.where("z is not null"), raster.where("z is null").select("row", "col")
    out, width = known, 1
    while not gaps.isEmpty() and width < most:
        block = lambda c: F.floor(F.col(c) / width)  # noqa: B023, E731
        around = F.explode(F.array(*[F.struct((block("row") + i).alias("br"), (block("col") + j).alias("bc")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("b")
        met = gaps.select("row", "col", around).select("row", "col", "b.br", "b.bc").join(known.select(block("row").alias("br"), block("col").alias("bc"), F.col("row").alias("r"), F.col("col").alias("c"), "z"), ["br", "bc"])
        d2 = (F.col("row") - F.col("r")) ** 2 + (F.col("col") - F.col("c")) ** 2
        found = met.groupBy("row", "col").agg(F.min(F.struct(d2.alias("d2"), "r", "c", "z")).alias("n")).where(F.col("n.d2") <= width * width).select("row", "col", F.col("n.z").alias("z"))
        out, gaps, width = out.unionByName(found), gaps.join(found, ["row", "col"], "left_anti"), 2 * width
    return out


def sample(points: DataFrame, raster: DataFrame, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """Each point's cell (node, x, y to row, col) and its values; a point outside the raster is an error when read.
    y0 is the upper border."""
    at = points.withColumns({"row": F.floor((y0 - F.col("y")) / dy).cast("long"), "col": F.floor((F.col("x") - x0) / dx).cast("long")})
    values = [c for c in raster.columns if c not in ("row", "col")]
    joined = at.join(raster.withColumn("_in", F.lit(True)), ["row", "col"], "left")
    outside = F.raise_error(F.lit("a point lies outside the raster"))
    checked = {c: F.when(F.col("_in"), F.col(c)).otherwise(outside.cast(joined.schema[c].dataType)) for c in ["row", *values]}
    return joined.withColumns(checked).drop("_in")


def nearest_axis(points: DataFrame, axis: DataFrame, value: str, at: str, name: str) -> DataFrame:
    """Adds the axis value nearest to each point's, ties to the lower.

    The distinct axis values, sorted, are one array beside each point, searched by halving: a look-up costs the
    logarithm of the axis. A grid line is one row of the axis; the array is as long as one side of one grid.
    """
    lines = axis.select(F.col(at).cast("double").alias("v")).where("v is not null").agg(F.array_sort(F.collect_set("v")).alias("_axis"))
    met = points.crossJoin(F.broadcast(lines))  # one row
    halved = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(F.size("_axis") + F.lit(1))).cast("int"))), F.struct(F.lit(0).alias("lo"), F.size("_axis").alias("hi")),
        lambda s, _: F.when(s["lo"] >= s["hi"], s).when(F.get(F.col("_axis"), F.shiftright(s["lo"] + s["hi"], 1)) < F.col(value), F.struct((F.shiftright(s["lo"] + s["hi"], 1) + 1).alias("lo"), s["hi"].alias("hi")))
        .otherwise(F.struct(s["lo"].alias("lo"), F.shiftright(s["lo"] + s["hi"], 1).alias("hi"))),
    )["lo"]
    met = met.withColumn("_at", halved)
    low, high = F.get("_axis", F.col("_at") - 1), F.get("_axis", F.col("_at"))
    near = F.when(low.isNull(), high).when(high.isNull(), low).when(F.col(value) - low <= high - F.col(value), low).otherwise(high)
    return met.withColumn(name, near.cast(axis.schema[at].dataType)).drop("_axis", "_at")


def inside(points: DataFrame, polygon: list[tuple[float, float]], buffer: float = 0.0) -> DataFrame:
    """Points inside a polygon (even-odd rule) or within `buffer` of its border. The border's segments are literals in
    the plan: no join."""
    x, y = F.col("x"), F.col("y")
    crossings, near = F.lit(0), F.lit(False)
    for (ax, ay), (bx, by) in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        if ay != by:
            cut = ((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
            crossings = crossings + cut.cast("int")
        if buffer:
            length = (bx - ax) ** 2 + (by - ay) ** 2
            t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / length)) if length else F.lit(0.0)
            near = near | ((x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by - ay)) ** 2 <= buffer**2)
    return points.where((crossings % 2 == 1) | near)


def thin(points: DataFrame, cell: float, best: str) -> DataFrame:
    """One point for each cell of a grid: the largest `best`, ties to the lowest id."""
    w = Window.partitionBy("gx", "gy").orderBy(F.desc(best), "id")
    rows = points.withColumns({"gx": F.floor(F.col("x") / cell), "gy": F.floor(F.col("y") / cell)})
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing on WGS 84 in a northern UTM zone (Krüger series to the third order, below a millimetre)."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (6 * zone - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500_000 + k0 * radius * east, k0 * radius * north


def laea_europe(east: Column, north: Column) -> tuple[Column, Column]:
    """Longitude and latitude on GRS 80 of the European equal-area grid (EPSG:3035; Snyder 1987, section 24)."""
    a, f, lon0, lat0, fe, fn = 6378137.0, 1 / 298.257222101, 10.0, math.radians(52.0), 4_321_000.0, 3_210_000.0
    e2 = f * (2 - f)
    e = math.sqrt(e2)

    def area(s: float) -> float:
        return (1 - e2) * (s / (1 - e2 * s * s) + math.atanh(e * s) / e)

    polar = area(1.0)
    beta0, radius = math.asin(area(math.sin(lat0)) / polar), a * math.sqrt(polar / 2)
    d = a * math.cos(lat0) / math.sqrt(1 - e2 * math.sin(lat0) ** 2) / (radius * math.cos(beta0))
    x, y = (east - fe) / d, (north - fn) * d
    rho = F.hypot(x, y)
    c = 2 * F.asin(rho / (2 * radius))
    beta = F.asin(F.cos(c) * math.sin(beta0) + F.when(rho > 0, y * F.sin(c) * math.cos(beta0) / rho).otherwise(0.0))
    lon = F.atan2(x * F.sin(c), rho * math.cos(beta0) * F.cos(c) - y * math.sin(beta0) * F.sin(c))
    lat = (
        beta + (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040) * F.sin(2 * beta)
        + (23 * e2**2 / 360 + 251 * e2**3 / 3780) * F.sin(4 * beta) + 761 * e2**3 / 45360 * F.sin(6 * beta)
    )
    for _ in range(2):  # the series is right to millimetres; Newton's steps on the authalic area settle the rest
        sine = F.sin(lat)
        flat = 1 - e2 * sine * sine
        lat = lat + flat * flat / (2 * F.cos(lat)) * (polar * F.sin(beta) / (1 - e2) - sine / flat - F.atanh(e * sine) / e)
    return F.when(rho > 0, lon0 + F.degrees(lon)).otherwise(F.lit(lon0)), F.degrees(lat)


def utm_inverse(east: Column, north: Column, zone: int) -> tuple[Column, Column]:
    """Longitude and latitude on WGS 84 of a place in a northern UTM zone (Krueger series)."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi0, eta0 = north / (k0 * radius), (east - 500_000) / (k0 * radius)
    xi, eta = xi0, eta0
    for j, c in enumerate(beta, 1):
        xi = xi - c * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - c * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi
    for j, c in enumerate(delta, 1):
        lat = lat + c * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + (6 * zone - 183), F.degrees(lat)
