import numpy as np
import pytest
from pyspark.sql import functions as F

from terrazone import __main__ as command
from terrazone.operators import timeaxis
from terrazone.plans import site


@pytest.fixture(scope="module")
def lattice(spark):
    """6 x 6 points, 36 epochs, two trends; every eleventh point lacks its fourth epoch."""
    rng = np.random.default_rng(7)
    node = np.arange(36)
    x, y, t = node % 6 * 20.0, node // 6 * 20.0, np.arange(36) * 12 / 365.25
    trend = np.where(x < 60, 0.08, 0.24)
    values = trend[:, None] * t + 0.05 * np.sin(2 * np.pi * t) + rng.normal(scale=0.025, size=(36, 36))
    rows = [(int(i), e, float(t[e]), 36, None if i % 11 == 0 and e == 3 else float(values[i, e])) for i in node.tolist() for e in range(36)]
    panel = timeaxis.with_periods(spark.createDataFrame(rows, "node long, e int, years double, n long, value double")).persist()
    points = spark.createDataFrame([(int(i), float(x[i]), float(y[i]), 100.0 + i, 5.0 + i % 3, float(i * 10), 0.01 * i, 1.0 + i % 2) for i in node.tolist()], "node long, x double, y double, elevation double, slope double, aspect double, curvature double, tri double")
    imagery = spark.createDataFrame([(int(i), [float(x[i]) / 100, float(y[i]) / 100], 0.0 if i == 0 else 1.0) for i in node.tolist()], "node long, z_o array<double>, q_o double")
    quality = spark.createDataFrame([(int(i), "coherence", 0.65 + 0.3 * i / 35, "higher_is_better") for i in node.tolist()], "node long, field string, value double, direction string")
    return panel, points, imagery, quality


@pytest.mark.parametrize("variant", ["Full", "GraphLaplacian"])
def test_whole_site(lattice, variant):
    panel, points, imagery, quality = lattice
    found = site.run(panel, points, 4, 0.08, 2, imagery, quality, variant, n_init=5, **({} if variant == "GraphLaplacian" else {"tol": 1e-7}))
    row = found.metrics.first()
    assert row.nodes == 36 and row.converged and row.fdd > 0 and row.fi >= 1 and row.k_star == 2
    assert found.links.agg(F.avg("omega")).first()[0] == pytest.approx(1) and found.rho.agg(F.avg("rho")).first()[0] == pytest.approx(1)


def test_commands(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(command, "session", lambda: spark)
    header = "pid,latitude,longitude,rmse,temporal_coherence,amplitude_dispersion,mean_velocity_std," + ",".join(f"201901{d:02d}" for d in range(1, 11))
    body = "\n".join(f"p{i},1,2,3,0.9,5,6," + ",".join(str(i + d / 10) for d in range(10)) for i in range(12))
    (tmp_path / "t.csv").write_text(f"{header}\n{body}\n")
    command.main(["prepare", "offida", str(tmp_path / "t.csv"), "--output", str(tmp_path / "site")])
    points = spark.read.parquet(str(tmp_path / "site/points"))
    assert points.count() == 12 and spark.read.json(str(tmp_path / "site/summary")).first().n_test == 2
    points.select("*", F.col("node").cast("double").alias("x"), F.lit(0.0).alias("y")).write.parquet(str(tmp_path / "site2/points"))
    spark.read.parquet(str(tmp_path / "site/obs")).write.partitionBy("period").parquet(str(tmp_path / "site2/obs"))
    points.select("node", (F.col("node") >= 6).cast("int").alias("label")).write.parquet(str(tmp_path / "labels"))
    command.main(["evaluate", str(tmp_path / "site2"), str(tmp_path / "labels"), "--output", str(tmp_path / "scores")])
    assert spark.read.json(str(tmp_path / "scores")).first().fdd == pytest.approx(0, abs=1e-12)
    rows = "site,method,FDD_mean,FDD_sample_sd,FDD_unit,FI_mean,FI_sample_sd,rank_FDD,rank_FI,seed_count\na,m,1,0,mm,5,0,1,2,5\na,n,2,0,mm,4,0,2,1,5\n"
    (tmp_path / "r.csv").write_text(rows)
    command.main(["rank", str(tmp_path / "r.csv"), "--output", str(tmp_path / "ranked")])
    (tmp_path / "bad.csv").write_text(rows.replace("5,0,1,2,5", "5,0,2,2,5"))
    with pytest.raises(ValueError, match="ranks"):
        command.main(["rank", str(tmp_path / "bad.csv"), "--output", str(tmp_path / "ranked2")])
