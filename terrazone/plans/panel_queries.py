"""Queries over panels: the time axis, node features, reliability, dispersion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazone.operators import features, metrics, reliability, timeaxis
from terrazone.sources.panels import epochs, event_panel, ship_panel, table

# SQL shared by the oracles ----------------------------------------------------------------------------------------

_AXIS = """
ep AS (SELECT t, CAST(row_number() OVER (ORDER BY t) - 1 AS INTEGER) AS e, (epoch_us(t) - min(epoch_us(t)) OVER ()) / 86400e6 / 365.25 AS years, count(*) OVER () AS n FROM (SELECT DISTINCT t FROM obs)),
axis AS (SELECT *, CASE WHEN e < floor(CAST(0.6 AS DOUBLE) * n) THEN 'train' WHEN e < floor(CAST(0.6 AS DOUBLE) * n) + floor(CAST(0.2 AS DOUBLE) * n) THEN 'val' ELSE 'test' END AS period FROM ep),
panel AS (SELECT node, e, years, n, period, value FROM (SELECT DISTINCT node FROM obs) CROSS JOIN axis LEFT JOIN obs USING (node, t))"""
SHIP = "obs AS (SELECT l_suppkey AS node, date_trunc('month', l_shipdate) AS t, avg(l_quantity) AS value FROM lineitem GROUP BY 1, 2)," + _AXIS
EVENT = "obs AS (SELECT user_id AS node, date_trunc('day', ts) AS t, sum(CAST(round(value * 100) AS BIGINT)) / count(value) / 100 AS value FROM events GROUP BY 1, 2)," + _AXIS
_FILL = """
seen AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN {{'y': years, 'v': value}} END IGNORE NULLS) OVER (PARTITION BY node ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l,
  first_value(CASE WHEN value IS NOT NULL THEN {{'y': years, 'v': value}} END IGNORE NULLS) OVER (PARTITION BY node ORDER BY e ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM {panel}),
work AS (SELECT node, e, years, n, period, value, coalesce(value, CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN l.v + (years - l.y) / (r.y - l.y) * (r.v - l.v) END, l.v, r.v) AS filled FROM seen)"""
FILL, FILL_TRAIN = _FILL.format(panel="panel"), "tr AS (SELECT * FROM panel WHERE period = 'train')," + _FILL.format(panel="tr")
RATE = "moved AS (SELECT *, (filled - lag(filled) OVER w) / (years - lag(years) OVER w) AS rate FROM work WINDOW w AS (PARTITION BY node ORDER BY e))"
RESIDUAL = """
valid AS (SELECT * FROM (SELECT *, count(value) OVER (PARTITION BY node) AS c FROM panel WHERE value IS NOT NULL) WHERE c >= 3),
res AS (SELECT node, e, abs(value - quantile_cont(value, 0.5) OVER (PARTITION BY node ORDER BY e ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS residual FROM valid),
scale AS (SELECT node, scale FROM (SELECT DISTINCT node FROM panel) LEFT JOIN (SELECT node, quantile_cont(residual, 0.5) AS scale FROM res GROUP BY node) USING (node)),
known AS (SELECT count(scale) AS c, quantile_cont(scale, 0.02) AS a, quantile_cont(scale, 0.98) AS b FROM scale),
qres AS (SELECT node, scale, CASE WHEN c < 2 OR b - a <= 1e-8 OR scale IS NULL THEN 1.0 ELSE least(greatest((b - scale) / (b - a + 1e-8), 0), 1) END AS q_res FROM scale, known)"""
QUALITY = """
quality AS (SELECT l_suppkey AS node, 'discount' AS field, avg(l_discount) AS value, 'lower_is_better' AS direction FROM lineitem GROUP BY 1 UNION ALL SELECT l_suppkey, 'quantity', avg(l_quantity), 'higher_is_better' FROM lineitem GROUP BY 1),
span AS (SELECT field, quantile_cont(value, 0.02) AS a, quantile_cont(value, 0.98) AS b FROM quality GROUP BY field),
share AS (SELECT node, CASE WHEN direction = 'higher_is_better' THEN least(greatest((value - a) / (b - a + 1e-8), 0), 1) ELSE least(greatest((b - value) / (b - a + 1e-8), 0), 1) END AS q FROM quality JOIN span USING (field)),
meta AS (SELECT node, CASE WHEN min(q) <= 0 THEN 0 ELSE exp(avg(ln(CASE WHEN q > 0 THEN q ELSE 1 END))) END AS q_meta FROM share GROUP BY node)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts)


def r6(*columns: str) -> list:
    return [(F.round(c, 6) + F.lit(0.0)).alias(c) for c in columns]


def sql6(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in columns)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# the time axis ----------------------------------------------------------------------------------------------------


@query(with_(SHIP) + " SELECT e, round(years, 6) AS years, period, n FROM axis")
def temporal_split(spark, sf_dir):
    months = table(spark, sf_dir, "lineitem").select(F.date_trunc("month", "l_shipdate").alias("t"))
    return epochs(months).select("e", F.round("years", 6).alias("years"), "period", "n")


@query(with_(SHIP) + " SELECT node, e, CASE WHEN period = 'train' THEN round(value, 6) END AS value, period = 'train' AND value IS NOT NULL AS valid FROM panel")
def causal_prefix_padded(spark, sf_dir):
    return timeaxis.train_prefix(ship_panel(spark, sf_dir)).select("node", "e", F.round("value", 6).alias("value"), "valid")


@query(with_(SHIP) + " SELECT max(n) AS full_epoch_count, CAST(floor(CAST(0.6 AS DOUBLE) * max(n)) AS BIGINT) - 1 AS last_index, FALSE AS validation_read, FALSE AS test_read, 'train_only' AS value_scope FROM panel")
def value_scope(spark, sf_dir):
    return timeaxis.value_scope(ship_panel(spark, sf_dir), "train_only")


@query(with_(EVENT, FILL) + f" SELECT node, e, {sql6('filled')} FROM work")
def working_interpolation(spark, sf_dir):
    return timeaxis.interpolate(event_panel(spark, sf_dir)).select("node", "e", *r6("filled"))


@query(with_(EVENT, FILL, RATE) + f" SELECT node, e, {sql6('rate')} FROM moved WHERE rate IS NOT NULL")
def time_aware_rate(spark, sf_dir):
    return timeaxis.rates(timeaxis.interpolate(event_panel(spark, sf_dir))).where("rate is not null").select("node", "e", *r6("rate"))


@query(with_(SHIP, FILL_TRAIN) + """,
seg AS (SELECT unnest(range(12)) AS segment), t AS (SELECT count(DISTINCT e) / 12.0 AS w FROM tr)
SELECT node, CAST(segment AS INTEGER) AS segment, round(sum(greatest(0, least(e + 1, (segment + 1) * w) - greatest(e, segment * w)) * filled) / any_value(w), 6) + 0.0 AS value
FROM work, seg, t WHERE least(e + 1, (segment + 1) * w) > greatest(e, segment * w) GROUP BY node, segment""")
def paa12(spark, sf_dir):
    train = timeaxis.interpolate(timeaxis.admitted(ship_panel(spark, sf_dir), "train"))
    length = train.agg(F.countDistinct("e")).first()[0]
    return timeaxis.segments(train, "filled", length).select("node", "segment", *r6("value"))


@query(with_(SHIP, FILL_TRAIN) + """,
mid AS (SELECT *, quantile_cont(filled, 0.5) OVER (PARTITION BY node) AS m FROM work),
dev AS (SELECT *, quantile_cont(abs(filled - m), 0.5) OVER (PARTITION BY node) AS d FROM mid)
SELECT node, e, round((filled - m) / (d + 1e-8), 6) + 0.0 AS normalised FROM dev""")
def row_robust_normalize(spark, sf_dir):
    train = timeaxis.interpolate(timeaxis.admitted(ship_panel(spark, sf_dir), "train"))
    return features.node_normalised(train).select("node", "e", *r6("normalised"))


_DESIGN = """
ax AS (SELECT e, years AS t, sin(2 * pi() * years) AS s, cos(2 * pi() * years) AS c FROM axis WHERE period = 'train'),
d0 AS (SELECT e, t - avg(t) OVER () AS t, s - avg(s) OVER () AS s, c - avg(c) OVER () AS c FROM ax),
p0 AS (SELECT sum(t * t) AS tt, sum(t * s) AS ts, sum(t * c) AS tc FROM d0),
d1 AS (SELECT e, s - ts / tt * t AS s, c - tc / tt * t AS c FROM d0, p0),
p1 AS (SELECT sum(s * s) AS ss, sum(s * c) AS sc, sum(c * c) AS cc FROM d1),
d2 AS (SELECT e, s - sc / cc * c AS s, c - sc / ss * s AS c FROM d1, p1),
p2 AS (SELECT sum(s * s) AS ss, sum(c * c) AS cc FROM d2),
wt AS (SELECT e, s / ss AS ws, c / cc AS wc FROM d2, p2),
amp AS (SELECT node, sqrt(sum(ws * filled) ** 2 + sum(wc * filled) ** 2) AS annual_amplitude FROM work JOIN wt USING (e) GROUP BY node)"""


@query(with_(SHIP, FILL_TRAIN, _DESIGN) + f" SELECT node, {sql6('annual_amplitude')} FROM amp")
def annual_amplitude(spark, sf_dir):
    train = timeaxis.interpolate(timeaxis.admitted(ship_panel(spark, sf_dir), "train"))
    return features.with_annual_weights(train).groupBy("node").agg(features.amplitude("filled").alias("annual_amplitude")).select("node", *r6("annual_amplitude"))


_LONG = """
half AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY e) - 1 AS i, floor(count(*) OVER (PARTITION BY node) / 2) AS h, quantile_cont(filled, 0.5) OVER (PARTITION BY node) AS m FROM moved),
stats AS (SELECT node, avg(filled) AS mean, stddev_pop(filled) AS std, quantile_cont(filled, 0.5) AS median, quantile_cont(abs(filled - m), 0.5) AS mad,
  quantile_cont(filled, 0.05) AS q05, quantile_cont(filled, 0.25) AS q25, quantile_cont(filled, 0.75) AS q75, quantile_cont(filled, 0.95) AS q95, regr_slope(filled, years) AS trend,
  avg(abs(rate)) AS mean_abs_rate, max(abs(rate)) AS max_abs_rate, max_by(filled, e) - min_by(filled, e) AS end_minus_start,
  avg(CASE WHEN i >= h THEN filled END) - avg(CASE WHEN i < h THEN filled END) AS late_minus_early FROM half GROUP BY node)"""


@query(with_(SHIP, FILL_TRAIN, RATE, _DESIGN, _LONG) + f" SELECT node, {sql6(*features.LONG_TERM)} FROM stats JOIN amp USING (node)")
def long_term_stats(spark, sf_dir):
    train = timeaxis.interpolate(timeaxis.admitted(ship_panel(spark, sf_dir), "train"))
    return features.long_term(train).select("node", *r6(*features.LONG_TERM))


_SCALED = ", ".join(f"round(({c} - quantile_cont({c}, 0.5) OVER ()) / (quantile_cont({c}, 0.75) OVER () - quantile_cont({c}, 0.25) OVER () + 1e-8), 6) + 0.0 AS {c}" for c in ("mean", "std", "trend"))


@query(with_(SHIP, FILL_TRAIN, RATE, _LONG) + f" SELECT node, {_SCALED} FROM stats")
def robust_scale(spark, sf_dir):
    train = timeaxis.interpolate(timeaxis.admitted(ship_panel(spark, sf_dir), "train"))
    names = ["mean", "std", "trend"]
    return features.robust_scale(features.long_term(train).select("node", *names), names).select("node", *r6(*names))


@query(with_(SHIP, FILL_TRAIN, RATE, _LONG) + " SELECT round(sqrt(sum(mean ** 2 + std ** 2 + median ** 2) / count(*)), 6) AS energy, count(*) AS n FROM stats")
def block_energy(spark, sf_dir):
    train = timeaxis.interpolate(timeaxis.admitted(ship_panel(spark, sf_dir), "train"))
    return features.block_energy(features.long_term(train), ["mean", "std", "median"]).select(*r6("energy"), "n")


@query()
def pca_spectrum(spark, sf_dir):
    """Shares of variance of the latent axes, from all three feature blocks."""
    _, found = features.latent(timeaxis.admitted(ship_panel(spark, sf_dir), "train"))
    return spark.createDataFrame([(k, float(v), float(s), k < found["components"]) for k, (v, s) in enumerate(zip(found["variances"], found["shares"], strict=True))], "axis int, variance double, cumulative double, kept boolean")


# reliability ------------------------------------------------------------------------------------------------------


def _quality(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("node")).agg(F.avg("l_discount").alias("discount"), F.avg("l_quantity").alias("quantity"))
    return rows.unpivot("node", ["discount", "quantity"], "field", "value")


def _audit(spark) -> DataFrame:
    return spark.createDataFrame([("discount", "ACCEPTED", "lower_is_better"), ("quantity", "ACCEPTED", "higher_is_better"), ("Tax", "ACCEPTED", "lower_is_better"), ("price", "REJECTED", None)], "field string, status string, direction string")


@query(with_(EVENT, RESIDUAL) + f" SELECT node, e, {sql6('residual')} FROM res")
def local_residual_median5(spark, sf_dir):
    return reliability.local_residuals(event_panel(spark, sf_dir)).select("node", "e", *r6("residual"))


@query(with_(EVENT, RESIDUAL) + f" SELECT node, {sql6('scale', 'q_res')} FROM qres")
def residual_reliability(spark, sf_dir):
    return reliability.residual_reliability(reliability.residual_scale(event_panel(spark, sf_dir))).select("node", *r6("scale", "q_res"))


@query(with_(QUALITY) + f" SELECT node, {sql6('q_meta')} FROM meta")
def metadata_reliability(spark, sf_dir):
    return reliability.metadata_reliability(reliability.quality_inputs(_quality(spark, sf_dir), _audit(spark))).select("node", *r6("q_meta"))


@query(with_(QUALITY) + " SELECT node, field, round(value, 6) AS value, direction FROM quality")
def quality_inputs(spark, sf_dir):
    return reliability.quality_inputs(_quality(spark, sf_dir), _audit(spark)).select("node", "field", *r6("value"), "direction")


@query("SELECT 'Tax' AS field, 'tax' AS found")
def dropped_quality_fields(spark, sf_dir):
    have = table(spark, sf_dir, "lineitem").select(F.explode(F.array(*map(F.lit, ["discount", "quantity", "tax"]))).alias("field"))
    return reliability.dropped_fields(have, _audit(spark)).select("field", "found")


@query(with_(SHIP, RESIDUAL, QUALITY) + """,
q AS (SELECT node, cbrt(least(greatest(coalesce(q_meta, 1) * q_valid * q_res, 0), 1)) AS q_d FROM (SELECT node, avg(CASE WHEN value IS NOT NULL THEN 1.0 ELSE 0.0 END) AS q_valid FROM panel GROUP BY node) JOIN qres USING (node) LEFT JOIN meta USING (node))
SELECT node, round(q_d, 6) AS q_d, round((q_d + 1e-8) / avg(q_d + 1e-8) OVER (), 6) AS rho FROM q""")
def node_reliability_rho(spark, sf_dir):
    fields = reliability.quality_inputs(_quality(spark, sf_dir), _audit(spark))
    return reliability.node_reliability(ship_panel(spark, sf_dir), fields).select("node", *r6("q_d", "rho"))


# dispersion -------------------------------------------------------------------------------------------------------


@query(with_(SHIP) + """,
cells AS (SELECT node, e, value - first_value(value) OVER (PARTITION BY node ORDER BY e) AS x FROM panel WHERE period = 'test' AND node NOT IN (SELECT node FROM panel WHERE period = 'test' AND value IS NULL)),
lab AS (SELECT s_suppkey AS node, s_nationkey AS label FROM supplier),
mid AS (SELECT label, e, quantile_cont(x, 0.5) AS m FROM cells JOIN lab USING (node) GROUP BY label, e)
SELECT round(sum(abs(x - m)) / count(*), 6) AS fdd, count(*) AS cells FROM cells JOIN lab USING (node) JOIN mid USING (label, e)""")
def fdd(spark, sf_dir):
    """Dispersion of shipped quantities around their nation's median, over suppliers seen in every test month."""
    panel = ship_panel(spark, sf_dir).where("period = 'test'")
    full = panel.groupBy("node").agg(F.count_if(F.col("value").isNull()).alias("m")).where("m = 0").select("node")
    labels = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("label"))
    return metrics.dispersion(panel.join(full, "node"), labels).select(*r6("fdd"), "cells")
