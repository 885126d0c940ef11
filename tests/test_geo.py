import io
import json
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrazone.operators import audits, terrain
from terrazone.sources import geo, readers, sinks, sites


def tiff(z, order="<", tiled=0, deflate=False, nodata=None, epsg=32633, predictor=1, scale=(10.0, 10.0), corner=(500_000.0, 4_700_000.0), geographic=False):
    """A one-band TIFF file by the book."""
    h, w = z.shape
    bw, bh = (tiled, tiled) if tiled else (w, 2)
    blocks = []
    for top in range(0, h, bh):
        for left in range(0, w, bw):
            part = z[top : top + bh, left : left + bw]
            if tiled:
                part = np.pad(part, ((0, bh - part.shape[0]), (0, bw - part.shape[1])))
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.zeros((len(part), 1), part.dtype))
            raw = part.astype(part.dtype.newbyteorder(order)).tobytes()
            if predictor == 3:
                planes = part.astype(part.dtype.newbyteorder(">")).view(np.uint8).reshape(len(part), -1, part.itemsize).transpose(0, 2, 1).reshape(len(part), -1)
                raw = np.diff(planes, axis=1, prepend=np.zeros((len(part), 1), np.uint8)).astype(np.uint8).tobytes()
            blocks.append(zlib.compress(raw) if deflate else raw)
    body, places = b"", []
    for b in blocks:
        places.append(8 + len(body))
        body += b
    kinds = {"u": 1, "i": 2, "f": 3}
    tags = [(256, "H", [w]), (257, "H", [h]), (258, "H", [z.itemsize * 8]), (259, "H", [8 if deflate else 1]), (277, "H", [1]), (317, "H", [predictor]), (339, "H", [kinds[z.dtype.kind]])]
    tags += [(322, "H", [tiled]), (323, "H", [tiled]), (324, "I", places), (325, "I", [len(b) for b in blocks])] if tiled else [(273, "I", places), (278, "H", [bh]), (279, "I", [len(b) for b in blocks])]
    tags += [(33550, "d", [*scale, 0.0]), (33922, "d", [0.0, 0.0, 0.0, *corner, 0.0]), (34735, "H", [1, 1, 0, 1, 2048 if geographic else 3072, 0, 1, epsg])]
    tags += [(42113, "s", str(nodata).encode() + b"\0")] if nodata is not None else []
    code = {"H": 3, "I": 4, "d": 12, "s": 2}
    tags.sort()
    at = 8 + len(body)
    extra_at, head, extra = at + 2 + 12 * len(tags) + 4, b"", b""
    for tag, kind, values in tags:
        raw = values if kind == "s" else struct.pack(f"{order}{len(values)}{kind}", *values)
        head += struct.pack(order + "HHI", tag, code[kind], len(values))
        if len(raw) <= 4:
            head += raw.ljust(4, b"\0")
        else:
            head += struct.pack(order + "I", extra_at + len(extra))
            extra += raw
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at) + body + struct.pack(order + "H", len(tags)) + head + b"\0" * 4 + extra


@pytest.mark.parametrize("how", [{}, {"order": ">"}, {"tiled": 16}, {"deflate": True}, {"tiled": 16, "deflate": True, "order": ">"}, {"predictor": 3, "deflate": True}])
def test_tiff(how):
    z = np.random.default_rng(1).normal(size=(21, 37)).astype("f4")
    z[3, 4] = -9999
    got = geo.decode_tiff(tiff(z, nodata=-9999, **how))
    want = z.astype(float)
    want[3, 4] = np.nan
    assert np.array_equal(got.z, want, equal_nan=True) and (got.x0, got.y0, got.dx, got.dy, got.epsg, got.geographic) == (500_000, 4_700_000, 10, 10, 32633, False)
    if how.get("predictor") != 3:
        i = np.arange(21 * 37, dtype="i2").reshape(21, 37)
        assert np.array_equal(geo.decode_tiff(tiff(i, **{**how, "predictor": 2})).z, i)
    with pytest.raises(ValueError, match="TIFF"):
        geo.decode_tiff(b"no")


def test_terrain_of_a_zipped_model(spark, tmp_path):
    plane = np.add.outer(-0.3 * 10 * np.arange(30), 0.4 * 10 * np.arange(40)).astype("f8") + 500  # rises to the east and, less, to the north
    plane[5, 5] = -32768
    with zipfile.ZipFile(tmp_path / "dem.zip", "w") as z:
        z.writestr("a/N43_x.tif", tiff(np.zeros((2, 2), "f4")))
        z.writestr("b/N42_x.TIF", tiff(plane, nodata=-32768))
    east, north = 500_000 + 10 * 20.5, 4_700_000 - 10 * 10.5
    place = terrain.utm_inverse(F.col("e"), F.col("n"), 33)
    points = spark.createDataFrame([(0, east, north)], "node long, e double, n double").select("node", place[0].alias("lon"), place[1].alias("lat"))
    got = geo.site_terrain(spark, str(tmp_path / "dem.zip"), points, "N42").first()
    assert got.elevation == plane[10, 20] and got.slope == pytest.approx(np.degrees(np.arctan(0.5))) and got.curvature == pytest.approx(0, abs=1e-9)
    assert geo.dem_member(["z.tif", "a.tif"], "none") == "a.tif"
    with pytest.raises(FileNotFoundError):
        geo.dem_member(["a.txt"])


def shapefile(points, columns, rows):
    shp = struct.pack(">7I", 9994, 0, 0, 0, 0, 0, 0) + b"\0" * 72
    for k, (x, y) in enumerate(points, 1):
        shp += struct.pack(">II", k, 10) + struct.pack("<Idd", 1, x, y)
    size = 12
    dbf = struct.pack("<BBBBIHH20x", 3, 0, 0, 0, len(rows), 33 + 32 * len(columns), 1 + size * len(columns))
    dbf += b"".join(c.encode().ljust(11, b"\0") + b"N" + b"\0" * 4 + bytes([size, 3]) + b"\0" * 14 for c in columns) + b"\r"
    dbf += b"".join(b" " + b"".join(("" if v is None else f"{v:.3f}").rjust(size).encode() for v in r) for r in rows)
    return shp, dbf


def test_zipped_shapefile(spark, tmp_path):
    columns = ["Coherence", "D_20150513", *(f"D_201601{d:02d}" for d in range(1, 11)), "Other"]
    shp, dbf = shapefile([(104.1, 33.5), (104.2, 33.6)], columns, [[0.5, 0.0, *range(1, 11), 7], [0.7, 0.0, *range(2, 11), None, 7]])
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("shape/p.shp", shp)
        z.writestr("shape/p.dbf", dbf)
    with zipfile.ZipFile(tmp_path / "outer.zip", "w") as z:
        z.writestr("readme.txt", "")
        z.writestr("inner.zip", inner.getvalue())
    points, observed = sites.shape_site(spark, str(tmp_path / "outer.zip"), 48, "product")
    assert points.count() == 2 and set(points.columns) >= {"node", "point_id", "x", "y", "lon", "lat", "Coherence"} and all(len(r.point_id) == 20 for r in points.collect())
    assert observed.count() == 20 and observed.where("value is null").count() == 1 and observed.agg(F.min("t")).first()[0].year == 2016
    assert sites.shape_site(spark, str(tmp_path / "outer.zip"), 48, "product", value_scope="train_only")[1].count() == 12


def netcdf(sizes, variables, version=1):
    """A classic NetCDF file; variables: name, dimensions, array, attributes. A dimension of length None grows."""
    text = lambda s: struct.pack(">I", len(s)) + s.encode().ljust(-(-len(s) // 4) * 4, b"\0")
    names, codes = list(sizes), {"f8": 6, "f4": 5, "i2": 3}
    attributes = lambda a: struct.pack(">II", 12 if a else 0, len(a)) + b"".join(text(k) + struct.pack(">II", 6, 1) + struct.pack(">d", v) for k, v in a.items())
    records = next((x.shape[0] for _, d, x, _ in variables if d and sizes[d[0]] is None), 0)
    offset = ">Q" if version == 2 else ">I"

    def head(begins):
        out = b"CDF" + bytes([version]) + struct.pack(">I", records) + struct.pack(">II", 10, len(names)) + b"".join(text(n) + struct.pack(">I", sizes[n] or 0) for n in names) + struct.pack(">II", 0, 0) + struct.pack(">II", 11, len(variables))
        for (n, dims, x, a), b in zip(variables, begins, strict=True):
            one = x[0] if dims and sizes[dims[0]] is None else x
            out += text(n) + struct.pack(">I", len(dims)) + b"".join(struct.pack(">I", names.index(d)) for d in dims) + attributes(a) + struct.pack(">II", codes[x.dtype.str[1:]], -(-one.nbytes // 4) * 4) + struct.pack(offset, b)
        return out

    pad = lambda raw: raw.ljust(-(-len(raw) // 4) * 4, b"\0")
    grows = [bool(d) and sizes[d[0]] is None for _, d, _, _ in variables]
    at, begins, fixed = len(head([0] * len(variables))), [0] * len(variables), b""
    for k, (_, _, x, _) in enumerate(variables):
        if not grows[k]:
            begins[k] = at + len(fixed)
            fixed += pad(x.astype(x.dtype.newbyteorder(">")).tobytes())
    tail = at + len(fixed)
    for k, (_, _, x, _) in enumerate(variables):
        if grows[k]:
            begins[k] = tail
            tail += len(pad(x[0].tobytes()))
    body = b"".join(pad(x[r : r + 1].astype(x.dtype.newbyteorder(">")).tobytes()) for r in range(records) for k, (_, _, x, _) in enumerate(variables) if grows[k])
    return head(begins) + fixed + body


@pytest.mark.parametrize("version", [1, 2])
def test_composites(spark, tmp_path, version):
    rng = np.random.default_rng(2)
    x, y, t = np.arange(5) * 10.0, 100 - np.arange(4) * 10.0, np.array([0.0, 31.0, 59.0])
    cube = {n: rng.integers(-9, 9, (3, 4, 5)).astype("i2") for n in ("NDVI", "NDMI", "BSI")}
    share = rng.uniform(-0.2, 1.2, (3, 4, 5)).astype("f4")
    share[0, 0, 0] = np.nan
    cube["NDVI"][1, 2, 3] = -99
    facts = {"scale_factor": 0.1, "_FillValue": -99.0}
    dims = ["t", "y", "x"]
    raw = netcdf({"t": None, "y": 4, "x": 5}, [("t", ["t"], t, {}), ("y", ["y"], y, {}), ("x", ["x"], x, {}), *((n, dims, c, facts) for n, c in cube.items()), ("valid_proportion", dims, share, {})], version)
    (tmp_path / "s.nc").write_bytes(raw)
    points = spark.createDataFrame([(7, 31.0, 78.0), (8, -50.0, 500.0)], "node long, x double, y double")
    got = {(r.node, r.t): r for r in geo.read_composites(spark, str(tmp_path / "s.nc"), points).collect()}
    assert len(got) == 6 and got[7, 31.0].ndvi is None and got[7, 0.0].ndmi == pytest.approx(cube["NDMI"][0, 2, 3] / 10)
    assert got[8, 0.0].valid == 0 and got[7, 59.0].valid == pytest.approx(float(np.clip(share[2, 2, 3], 0, 1)))
    with pytest.raises(ValueError, match="lacks"):
        geo.decode_netcdf(raw, ["absent"])
    (tmp_path / "day_20200102.nc").write_bytes(b"CDF")
    files = geo.composite_files(spark, str(tmp_path)).collect()
    assert [str(r.day) for r in files] == ["2020-01-02", "None"]


def test_polygon_site(spark, tmp_path):
    table = "pid,latitude,longitude,rmse,temporal_coherence,amplitude_dispersion,mean_velocity_std,20200101,20200113,20200125,20200206,20200218\n"
    table += "b,43.0000,13.0000,1,0.5,1,1,1,2,3,4,5\na,43.00001,13.00001,1,0.9,1,1,1,2,,4,5\nfar,43.1,13.1,1,0.9,1,1,1,2,3,4,5\nnear,43.0000,13.0030,1,0.4,1,1,0,0,0,0,0\n"
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("product.csv", table)
    ring = [[12.999, 42.999], [13.001, 42.999], [13.001, 43.001], [12.999, 43.001], [12.999, 42.999]]
    (tmp_path / "p.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"properties": {"ID": 12.0}, "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"properties": {"ID": 13}, "geometry": None}]}))
    polygon = sites.read_polygon(spark, str(tmp_path / "p.geojson"), "ID", "12")
    assert len(polygon) == 4
    points, observed = sites.polygon_site(spark, str(tmp_path / "t.zip"), polygon, 33, scratch=str(tmp_path / "scratch"))
    got = {r.point_id: r.node for r in points.collect()}
    assert set(got) >= {"near"} and "far" not in got and len(got) in (2, 3)  # a and b share a cell or lie on both sides of its border
    assert "a" in got and observed.where(f"node = {got['a']}").count() == 5
    with pytest.raises(ValueError, match="polygon"):
        sites.read_polygon(spark, str(tmp_path / "p.geojson"), "ID", "99")


def test_european_site(spark, tmp_path):
    (tmp_path / "m.csv").write_text("pid;easting;northing;coherence;vel_std;D05072015;D17072015;D29072015;D10082015;D22082015\nq;4321000;3210000;0.5;0.1;1;2;3;4;5\np;4100000;2300000;0.5;0.1;1;2;3;4;5\n")
    points, observed = sites.european_site(spark, str(tmp_path / "m.csv"), 32)
    p, q = points.orderBy("node").collect()
    assert (q.lon, q.lat) == (10.0, pytest.approx(52.0, abs=1e-12)) and p.point_id == "p" and observed.count() == 10
    assert sites.european_site(spark, str(tmp_path / "m.csv"), 32, most=1)[0].count() == 1


def test_raster_site(spark, tmp_path):
    rng = np.random.default_rng(4)
    for name in ("ve", "vn"):
        (tmp_path / name).mkdir()
        for day in ("20200101", "20200113", *(["20200125"] if name == "ve" else [])):
            z = rng.normal(size=(3, 4)).astype("f4")
            z[0, 0] = 0
            z[1, 1] = np.nan if day == "20200113" else 1
            (tmp_path / name / f"{name}_{day}.tif").write_bytes(tiff(z))
    aspect = spark.createDataFrame([(r, c, 90.0) for r in range(3) for c in range(4)], "row long, col long, aspect double")
    place = geo.Raster(np.empty((3, 4)), 0.0, 30.0, 10.0, 10.0, 32648, False)
    points, observed = sites.raster_site(spark, {n: str(tmp_path / n) for n in ("ve", "vn")}, place, ("ve", "vn"), aspect)
    assert points.count() == 10 and observed.count() == 20 and points.agg(F.max("y")).first()[0] == 25.0


def test_settings_and_records(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"k": 3}))
    assert readers.read_config(spark, str(tmp_path / "c.json"), ["k"]) == {"k": 3}
    with pytest.raises(ValueError, match="lambda"):
        readers.read_config(spark, str(tmp_path / "c.json"), ["lambda"])
    (tmp_path / "m.csv").write_text("start,end\n2020-02-01,2020-02-29\n2020-01-01,2020-01-31\n")
    assert [str(r.start) for r in readers.read_manifest(spark, str(tmp_path / "m.csv")).collect()] == ["2020-01-01", "2020-02-01"]
    with pytest.raises(ValueError, match="provenance"):
        audits.site_records({"optical_audit": 1})
    audits.inventory_audit(True, "evaluation")
    with pytest.raises(audits.LeakageError):
        audits.inventory_audit(True, "selection")
    scenes = {"provenance_complete": True, "acquisition_times": ["2020-01-01", "2020-02-01"], "acquisition_ids": ["a", "b"]}
    assert audits.optical_source(spark, scenes, "2020-03-01").checked == 2
    for wrong in ({**scenes, "acquisition_ids": ["a"]}, {**scenes, "provenance_complete": False}, {**scenes, "acquisition_times": ["2020-01-01", "2021-01-01"]}, {"provenance_complete": True, "process_graph": {}}):
        with pytest.raises(audits.LeakageError):
            audits.optical_source(spark, wrong, "2020-03-01")
    kept = sinks.written(spark.range(3), "kept")
    assert kept.count() == 3 and kept.columns == ["id"]
