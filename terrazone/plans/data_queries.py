"""Queries over sources, audits, rasters, sets and text; the experiment and the baselines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazone.functions.columns import is_sha256, point_id, stable_id
from terrazone.operators import audits, baselines, experiment, terrain, timeaxis
from terrazone.plans.panel_queries import FILL_TRAIN, SHIP, sql6, with_
from terrazone.sources import readers, sinks
from terrazone.sources.panels import epochs, ship_panel, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# top k and sets ---------------------------------------------------------------------------------------------------


@query("SELECT CAST(id AS VARCHAR) AS id, x, y, coh FROM (SELECT *, row_number() OVER (PARTITION BY floor(x / 20), floor(y / 20) ORDER BY coh DESC, id) AS r FROM (SELECT c_custkey AS id, c_acctbal / 10 AS x, CAST(c_custkey % 500 AS DOUBLE) AS y, c_nationkey AS coh FROM customer)) WHERE r = 1")
def grid_dedup(spark, sf_dir):
    points = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 10).alias("x"), (F.col("c_custkey") % 500).cast("double").alias("y"), F.col("c_nationkey").alias("coh"))
    return terrain.thin(points, 20.0, "coh").select(F.col("id").cast("string").alias("id"), "x", "y", "coh")


@query("SELECT s_name AS id FROM supplier ORDER BY s_name LIMIT 7")
def deterministic_limit(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_name").alias("id")).orderBy("id").limit(7)


@query("SELECT strftime(t, '%Y-%m') AS month FROM (SELECT date_trunc('month', o_orderdate) AS t FROM orders INTERSECT SELECT date_trunc('month', l_shipdate) FROM lineitem)")
def date_intersection(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.date_trunc("month", "o_orderdate").alias("t"))
    b = table(spark, sf_dir, "lineitem").select(F.date_trunc("month", "l_shipdate").alias("t"))
    return a.intersect(b).select(F.date_format("t", "yyyy-MM").alias("month"))


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49")
def set_difference(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey").join(used, "p_partkey", "left_anti").distinct()


@query("SELECT l_orderkey AS k, 'line' AS side FROM lineitem WHERE l_quantity < 3 UNION ALL SELECT o_orderkey, 'order' FROM orders WHERE o_totalprice < 5000")
def union_all(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").where("l_quantity < 3").select(F.col("l_orderkey").alias("k"), F.lit("line").alias("side"))
    b = table(spark, sf_dir, "orders").where("o_totalprice < 5000").select(F.col("o_orderkey").alias("k"), F.lit("order").alias("side"))
    return a.unionByName(b)


# rasters ----------------------------------------------------------------------------------------------------------

_CUBE = "cube AS (SELECT l_suppkey % 10 AS row, CAST(floor(l_suppkey / 10) AS BIGINT) AS col, year(l_shipdate) AS e, sum(CASE WHEN l_suppkey % 7 = 0 THEN 0 ELSE l_quantity END) AS ve, sum(CASE WHEN l_suppkey % 7 = 0 THEN 0 ELSE l_linenumber END) AS vn FROM lineitem GROUP BY 1, 2, 3)"


def _cube(spark, sf_dir) -> DataFrame:
    zero = F.col("l_suppkey") % 7 == 0
    by = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("row"), F.floor(F.col("l_suppkey") / 10).alias("col"), F.year("l_shipdate").alias("e"))
    return by.agg(F.sum(F.when(zero, 0).otherwise(F.col("l_quantity"))).alias("ve"), F.sum(F.when(zero, 0).otherwise(F.col("l_linenumber"))).alias("vn"))


@query(with_(_CUBE) + " SELECT row, col, bool_and(ve = 0 AND vn = 0) AS invalid, bool_or(ve = 0 OR vn = 0) AND NOT bool_and(ve = 0 AND vn = 0) AS uneven FROM cube GROUP BY row, col")
def source_support_mask(spark, sf_dir):
    return audits.support_mask(_cube(spark, sf_dir), ["ve", "vn"])


@query(with_(_CUBE) + " SELECT row, col, CAST(sum(CASE WHEN ve <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS valid, sum(CASE WHEN ve <> 0 THEN 1 ELSE 0 END) >= ceil(CAST(0.8 AS DOUBLE) * (SELECT count(DISTINCT e) FROM cube)) AS kept FROM cube GROUP BY row, col")
def joint_validity_80(spark, sf_dir):
    return audits.joint_validity(_cube(spark, sf_dir), ["ve", "vn"], nodata=0.0)


@query(with_(_CUBE) + " SELECT row, col, e, round(ve * sin(radians((row * 37 + col * 11) % 360)) + vn * cos(radians((row * 37 + col * 11) % 360)), 6) + 0.0 AS d FROM cube")
def downslope_projection(spark, sf_dir):
    rows = _cube(spark, sf_dir).withColumn("aspect", (F.col("row") * 37 + F.col("col") * 11) % 360)
    return rows.select("row", "col", "e", (F.round(audits.downslope(F.col("ve"), F.col("vn"), F.col("aspect")), 6) + 0.0).alias("d"))


_LATTICE = "r AS (SELECT CAST(floor(p_partkey / 40) AS BIGINT) AS row, p_partkey % 40 AS col, p_retailprice + 10 * p_size AS z FROM part)"


def _lattice(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.floor(k / 40).alias("row"), (k % 40).alias("col"), (F.col("p_retailprice") + 10 * F.col("p_size")).alias("z"))


def _grad(v: str, over: str, by: str, step: float) -> str:
    w = f"(PARTITION BY {over} ORDER BY {by})"
    return f"CASE WHEN lag({v}) OVER {w} IS NULL THEN (lead({v}) OVER {w} - {v}) / {step} WHEN lead({v}) OVER {w} IS NULL THEN ({v} - lag({v}) OVER {w}) / {step} ELSE (lead({v}) OVER {w} - lag({v}) OVER {w}) / (2 * {step}) END"


@query(with_(_LATTICE) + f""",
g AS (SELECT *, {_grad('z', 'row', 'col', 30.0)} AS gx, {_grad('z', 'col', 'row', 20.0)} AS gy FROM r),
h AS (SELECT *, {_grad('gx', 'row', 'col', 30.0)} AS gxx, {_grad('gy', 'col', 'row', 20.0)} AS gyy FROM g),
n AS (SELECT h.row, h.col, avg(b.z) AS m, avg(b.z * b.z) AS q FROM h, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j), (SELECT max(row) AS mr, max(col) AS mc FROM r), r b
  WHERE b.row = least(greatest(h.row + i, 0), mr) AND b.col = least(greatest(h.col + j, 0), mc) GROUP BY h.row, h.col)
SELECT row, col, round(degrees(atan(sqrt(gx ** 2 + gy ** 2))), 5) AS slope, round((degrees(atan2(-gx, -gy)) + 360) % 360, 5) AS aspect, round(gxx + gyy, 5) + 0.0 AS curvature, round(sqrt(greatest(q - m * m, 0)), 4) AS tri FROM h JOIN n USING (row, col)""")
def raster_terrain(spark, sf_dir):
    made = terrain.derived(_lattice(spark, sf_dir), 30.0, 20.0)
    return made.select("row", "col", F.round("slope", 5).alias("slope"), F.round("aspect", 5).alias("aspect"), (F.round("curvature", 5) + 0.0).alias("curvature"), F.round("tri", 4).alias("tri"))


@query(with_(_LATTICE) + """,
k AS (SELECT * FROM r WHERE (row * 7 + col) % 11 <> 0), g AS (SELECT row, col FROM r WHERE (row * 7 + col) % 11 = 0),
f AS (SELECT g.row, g.col, min({'d': (g.row - k.row) ** 2 + (g.col - k.col) ** 2, 'r': k.row, 'c': k.col, 'z': k.z}) AS n FROM g, k GROUP BY g.row, g.col)
SELECT row, col, z FROM k UNION ALL SELECT row, col, n.z FROM f""")
def raster_fill(spark, sf_dir):
    gap = (F.col("row") * 7 + F.col("col")) % 11 == 0
    return terrain.fill_nearest(_lattice(spark, sf_dir).withColumn("z", F.when(~gap, F.col("z"))))


_POLYGON = [(0.0, 0.0), (6000.0, 500.0), (9000.0, 15.0), (7000.0, 22.0), (2000.0, 18.0)]


@query("""WITH p AS (SELECT c_custkey AS id, c_acctbal AS x, c_nationkey + 0.25 AS y FROM customer),
s AS (SELECT * FROM (VALUES (0, 0, 6000, 500), (6000, 500, 9000, 15), (9000, 15, 7000, 22), (7000, 22, 2000, 18), (2000, 18, 0, 0)) t(ax, ay, bx, by_)),
c AS (SELECT id, sum(CASE WHEN (ay > y) <> (by_ > y) AND x < (bx - ax) * (y - ay) / (by_ - ay) + ax THEN 1 ELSE 0 END) AS n,
  min((x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by_ - ay)) ** 2) AS d FROM (SELECT *, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / ((bx - ax) ** 2 + (by_ - ay) ** 2))) AS t FROM p, s) GROUP BY id)
SELECT id FROM c WHERE n % 2 = 1 OR d <= 4""")
def point_in_polygon(spark, sf_dir):
    points = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), (F.col("c_nationkey") + 0.25).alias("y"))
    return terrain.inside(points, _POLYGON, buffer=2.0).select("id")


@query(with_(_LATTICE) + " SELECT c_custkey AS node, z FROM customer JOIN r ON row = floor(4.5 - c_custkey % 5) AND col = floor((c_acctbal - -2000) / 400.0)")
def nearest_cell(spark, sf_dir):
    points = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 5).cast("double").alias("y"))
    return terrain.sample(points, _lattice(spark, sf_dir), -2000.0, 4.5, 400.0, 1.0).select("node", "z")


@query("WITH a AS (SELECT DISTINCT CAST(p_size AS DOUBLE) * 200 AS g FROM part) SELECT s_suppkey AS node, min_by(g, {'d': abs(g - s_acctbal), 'g': g}) AS g FROM supplier, a GROUP BY s_suppkey")
def nearest_axis(spark, sf_dir):
    axis = table(spark, sf_dir, "part").select((F.col("p_size").cast("double") * 200).alias("at")).distinct()
    points = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_acctbal").alias("v"))
    return terrain.nearest_axis(points, axis, "v", "at", "g").select("node", "g")


# text, dates, digests ---------------------------------------------------------------------------------------------


@query("SELECT s_suppkey AS node, 'site:' || substr(sha256(s_name || '|' || CAST(s_suppkey AS VARCHAR) || '|' || printf('%.9f', s_acctbal)), 1, 20) AS id, TRUE AS good, regexp_replace(trim('  ' || CAST(s_suppkey AS VARCHAR) || '.0 '), '\\.0$', '') AS point_id FROM supplier")
def stable_ids(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    made = stable_id("site:", [F.col("s_name"), F.col("s_suppkey").cast("string"), F.format_string("%.9f", "s_acctbal")])
    whole = F.sha2(F.col("s_name").cast("binary"), 256)
    return s.select(F.col("s_suppkey").alias("node"), made.alias("id"), is_sha256(F.upper(whole)).alias("good"), point_id(F.concat(F.lit("  "), F.col("s_suppkey").cast("string"), F.lit(".0 "))).alias("point_id"))


@query("SELECT sha256(string_agg(s_name, chr(10) ORDER BY s_suppkey)) AS point_ids_sha256, count(*) AS n_points FROM supplier")
def ids_digest(spark, sf_dir):
    return sinks.ids_digest(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_name").alias("point_id")))


@query("""WITH b AS (SELECT n_nationkey AS k, DATE '2015-07-04' + CAST(n_nationkey * 13 AS INTEGER) AS lo, DATE '2016-02-16' + CAST(n_nationkey * 7 AS INTEGER) AS hi FROM nation),
m AS (SELECT k, lo, hi, unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH)) AS m FROM b)
SELECT k, strftime(greatest(CAST(m AS DATE), lo), '%Y-%m-%d') AS start, strftime(least(last_day(CAST(m AS DATE)), hi), '%Y-%m-%d') AS stop FROM m""")
def month_intervals(spark, sf_dir):
    k = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(k.alias("k"), F.date_add(F.lit("2015-07-04").cast("date"), k * 13).alias("lo"), F.date_add(F.lit("2016-02-16").cast("date"), k * 7).alias("hi"))
    return rows.select("k", F.explode(readers.month_intervals(F.col("lo"), F.col("hi"))).alias("m")).select("k", F.col("m.start").cast("string").alias("start"), F.col("m.stop").cast("string").alias("stop"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN json_exists(props, '$.job') THEN '' ELSE 'job' END AS missing FROM events")
def json_required_keys(spark, sf_dir):
    rows = audits.missing_keys(table(spark, sf_dir, "events"), "props", ["k", "job"])
    return rows.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.array_join("missing", ",").alias("missing"))


# audits -----------------------------------------------------------------------------------------------------------


@query("SELECT event_type AS source, count(*) AS checked, count(*) FILTER (ts > TIMESTAMP '2024-01-20 00:00:00') AS late FROM events GROUP BY 1")
def leakage_audit(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    cutoff = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return e.groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("checked"), F.count_if(F.col("ts").cast("timestamp_ntz") > cutoff).alias("late"))


@query(with_(SHIP) + " SELECT count(*) AS checked, 0 AS wrong, count(DISTINCT period) AS periods FROM axis")
def split_audit(spark, sf_dir):
    months = table(spark, sf_dir, "lineitem").select(F.date_trunc("month", "l_shipdate").alias("t"))
    return audits.split_audit(epochs(months)).select("checked", F.col("wrong").cast("int").alias("wrong"), "periods")


@query(with_(SHIP) + " SELECT e FROM axis WHERE period = 'test'")
def epochs_audit(spark, sf_dir):
    axis = epochs(table(spark, sf_dir, "lineitem").select(F.date_trunc("month", "l_shipdate").alias("t")))
    return audits.epochs_audit(axis.select("e"), axis, "train_val")


@query("SELECT 0 AS valid_without_value, 0 AS repeated_cells, 0 AS not_finite")
def dataset_validation(spark, sf_dir):
    obs = ship_panel(spark, sf_dir).select("node", "e", "value", F.col("value").isNotNull().alias("valid"))
    return audits.validity(obs).select(*[F.col(c).cast("int").alias(c) for c in ("valid_without_value", "repeated_cells", "not_finite")])


@query("SELECT (SELECT count(*) FROM (SELECT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer WHERE c_nationkey < 20)) AS left_only, (SELECT count(*) FROM (SELECT c_nationkey FROM customer WHERE c_nationkey < 20 EXCEPT SELECT s_nationkey FROM supplier)) AS right_only")
def alignment_check(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return audits.alignment(a, table(spark, sf_dir, "customer").where("c_nationkey < 20").select(F.col("c_nationkey").alias("k")), "k")


GRAPH = {
    "load": {"process_id": "load_collection", "arguments": {"temporal_extent": ["2019-01-01", "2021-12-31"]}},
    "scl": {"process_id": "to_scl_dilation_mask", "arguments": {"data": {"from_node": "load"}}},
    "masked": {"process_id": "mask", "arguments": {"data": {"from_node": "load"}, "mask": {"from_node": "scl"}}},
    "monthly": {"process_id": "aggregate_temporal_period", "arguments": {"data": {"from_node": "masked"}, "period": "month"}},
    "valid": {"process_id": "aggregate_temporal_period", "arguments": {"data": [{"from_node": "scl"}]}},
    "save": {"process_id": "save_result", "arguments": {"data": {"from_node": "monthly"}}},
}


@query("""WITH RECURSIVE e(p, c) AS (VALUES ('load', 'scl'), ('load', 'masked'), ('scl', 'masked'), ('masked', 'monthly'), ('scl', 'valid'), ('monthly', 'save')),
a AS (SELECT c, p FROM e UNION SELECT a.c, e.p FROM a JOIN e ON a.p = e.c) SELECT c AS child, p AS ancestor FROM a""")
def process_graph_ancestors(spark, sf_dir):
    return audits.ancestors(audits.graph_tables(spark, GRAPH)[1])


@query("SELECT 1 AS loads, 2 AS composites, 1 AS masks, 2 AS checked, 0 AS open_extents, 0 AS late_extents, 0 AS unfiltered, 0 AS unmasked, 1 AS masked_composites")
def process_graph_audit(spark, sf_dir):
    found = audits.graph_audit(*audits.graph_tables(spark, GRAPH), "2022-01-01")
    return found.select(*[F.col(c).cast("int").alias(c) for c in found.columns])


# experiment and baselines -----------------------------------------------------------------------------------------


@query()
def controlled_experiment(spark, sf_dir):
    """The whole experiment: all blocks, 20 seeds."""
    return experiment.run(spark, list(range(20)))


@query()
def descriptor_baseline(spark, sf_dir):
    """Zones of suppliers by clustered descriptors of their training series."""
    train = timeaxis.interpolate(timeaxis.admitted(ship_panel(spark, sf_dir), "train"))
    return baselines.descriptor_zones(baselines.descriptors(train), 4)


@query(with_(SHIP, FILL_TRAIN) + f" SELECT node, {sql6('total', 'rms')} FROM (SELECT node, sum(filled) AS total, sqrt(avg(filled * filled)) AS rms FROM work GROUP BY node)")
def series_descriptors(spark, sf_dir):
    train = timeaxis.interpolate(timeaxis.admitted(ship_panel(spark, sf_dir), "train"))
    return baselines.descriptors(train).select("node", *[(F.round(c, 6) + 0.0).alias(n) for c, n in (("sum", "total"), ("rms", "rms"))])


@query("SELECT s_suppkey AS node, round(radians(s_nationkey), 6) AS a, round(degrees(atan2(s_acctbal, 100)), 6) AS b, round(sqrt(s_acctbal ** 2 + 9), 6) AS c FROM supplier")
def scalar_functions(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.round(F.radians("s_nationkey"), 6).alias("a"), F.round(F.degrees(F.atan2("s_acctbal", F.lit(100.0))), 6).alias("b"), F.round(F.hypot("s_acctbal", F.lit(3.0)), 6).alias("c"))
