import json
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrazone.sources import panels, readers, sinks
from terrazone.streaming import epochs as arriving


def test_wide_table(spark, tmp_path):
    (tmp_path / "m.csv").write_text("pid;easting;northing;coherence;vel_std;D01012015;D05072015;D17072015;D29072015;D10082015;D22082015\n a.0;1;2;0.5;0.1;9;1.5;;2;3;4\nb;3;4;0.6;0.2;9;1;2;3;4;5\n")
    points, observed = readers.read_wide(spark, str(tmp_path / "m.csv"), readers.MENDATICA)
    assert [r.point_id for r in points.orderBy("point_id").collect()] == ["a", "b"]
    rows = observed.orderBy("point_id", "t").collect()
    assert len(rows) == 10 and rows[0].value == 1.5 and rows[1].value is None and str(rows[0].t)[:10] == "2015-07-05"
    assert readers.read_wide(spark, str(tmp_path / "m.csv"), readers.MENDATICA, "train_only")[1].count() == 6
    grid = panels.grid(observed.withColumnRenamed("point_id", "node"))
    assert grid.count() == 10 and grid.where("period = 'train'").count() == 6


def test_zip_in_zip(spark, tmp_path):
    inner = tmp_path / "inner.zip"
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("a.csv", "x,y\n1,2\n")
    with zipfile.ZipFile(tmp_path / "outer.zip", "w") as z:
        z.write(inner, "inner.zip")
        z.writestr("notes.txt", "no")
    assert [r.line for r in readers.read_zipped(spark, str(tmp_path / "outer.zip")).collect()] == ["x,y", "1,2"]


def test_rasters(spark, tmp_path):
    for day in ("20200101", "20200113"):
        np.save(tmp_path / f"ve_{day}.npy", np.array([[1.0, np.nan], [3.0, float(day[-1])]]))
    (tmp_path / "readme.txt").write_text("no date")
    rows = readers.read_raster_series(spark, str(tmp_path)).collect()
    assert len(rows) == 8 and sum(r.value is None for r in rows) == 2 and {str(r.day) for r in rows} == {"2020-01-01", "2020-01-13"}


def test_provenance(spark, tmp_path):
    record = dict.fromkeys(readers.PROVENANCE_KEYS, "x") | {"temporal_extent": ["2019-01-01", "2020-01-01"], "train_cutoff": "2020-01-01"}
    (tmp_path / "p.json").write_text(json.dumps(record, indent=1))
    assert readers.read_provenance(spark, str(tmp_path / "p.json"))["site"] == "x"
    (tmp_path / "q.json").write_text(json.dumps({k: v for k, v in record.items() if k != "bands"}))
    with pytest.raises(ValueError, match="bands"):
        readers.read_provenance(spark, str(tmp_path / "q.json"))


def test_sinks(spark, data, tmp_path):
    p = panels.ship_panel(spark, data)
    points = p.select("node", F.col("node").cast("string").alias("point_id")).distinct()
    summary = sinks.write_site(points, p, p.select("e", "years", "period").distinct(), str(tmp_path / "site")).first()
    assert summary.n_points == 10 and spark.read.parquet(str(tmp_path / "site/obs")).where("period = 'train'").count() == 10 * summary.n_train
    sinks.write_table(points, str(tmp_path / "t"), ["node"])
    assert readers.read_results(spark, str(tmp_path / "t"), "node long, point_id string").count() == 10


def test_streams(spark, tmp_path):
    rows = [(1, "2020-01-01 06:00:00", 1.0), (1, "2020-01-01 18:00:00", 3.0), (2, "2020-01-02 00:00:00", 5.0), (1, "2020-01-09 00:00:00", 7.0)]
    for k, r in enumerate(rows):
        spark.createDataFrame([r], "node long, t string, value double").withColumn("t", F.to_timestamp("t")).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        time.sleep(0.02)
    source = lambda: spark.readStream.schema("node long, t timestamp, value double").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))

    def drain(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    kept, late = arriving.admit(source(), "t", "2020-01-05")
    assert len(drain(kept, "kept", "append")) == 3 and len(drain(late, "late", "append")) == 1
    closed = drain(arriving.windowed_panel(source(), "node", "t", "value"), "closed", "append")
    assert {(r.node, r.value, r.n) for r in closed} == {(1, 2.0, 2), (2, 5.0, 1)}
    rates = drain(arriving.last_rates(source(), "node", "t", "value"), "rates", "update")
    last = max((r for r in rates if r.node == 1), key=lambda r: r.t)
    assert last.value == 7.0 and last.rate == pytest.approx(4 / (7.25 / 365.25))
