"""Queries over sources, coordinate systems, guards and tables of a run."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazone.functions.columns import is_sha256
from terrazone.operators import audits, metrics, terrain
from terrazone.sources import readers, sinks
from terrazone.sources.panels import sites, table, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# coordinate systems -----------------------------------------------------------------------------------------------

_F = 1 / 298.257223563
_N = _F / (2 - _F)
_R = 6378137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_E = 2 * math.sqrt(_N) / (1 + _N)


def _utm_sql(source: str, zone: int) -> str:
    series = lambda own, other, a, b: " + ".join(f"{c!r} * {a}(2 * {j} * {own}) * {b}(2 * {j} * {other})" for j, c in enumerate(_ALPHA, 1))
    return f"""u1 AS (SELECT *, sin(radians(lat)) AS s, radians(lon - {6 * zone - 183}) AS lam FROM {source}),
u2 AS (SELECT *, sinh(atanh(s) - {_E!r} * atanh({_E!r} * s)) AS t FROM u1),
u3 AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM u2),
u4 AS (SELECT *, 500000 + {0.9996 * _R!r} * (eta + {series("xi", "eta", "cos", "sinh")}) AS x, {0.9996 * _R!r} * (xi + {series("xi", "eta", "sin", "cosh")}) AS y FROM u3)"""


_PLACES = "p AS (SELECT c_custkey AS node, 9 + (c_custkey % 599) / 100.0::DOUBLE AS lon, 38 + (c_custkey % 997) / 100.0::DOUBLE AS lat FROM customer)"


def _places(spark, sf_dir) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(c.alias("node"), (9 + (c % 599) / 100).alias("lon"), (38 + (c % 997) / 100).alias("lat"))


@query(f"WITH {_PLACES}, {_utm_sql('p', 33)} SELECT node, round(x, 3) AS x, round(y, 3) AS y FROM u4")
def utm_forward(spark, sf_dir):
    x, y = terrain.utm(F.col("lon"), F.col("lat"), 33)
    return _places(spark, sf_dir).select("node", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(f"WITH {_PLACES} SELECT node, round(lon, 7) AS lon, round(lat, 7) AS lat FROM p")
def utm_there_and_back(spark, sf_dir):
    x, y = terrain.utm(F.col("lon"), F.col("lat"), 33)
    there = _places(spark, sf_dir).select("node", x.alias("x"), y.alias("y"))
    lon, lat = terrain.utm_inverse(F.col("x"), F.col("y"), 33)
    return there.select("node", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


_F80 = 1 / 298.257222101
_E2 = _F80 * (2 - _F80)


def _area(s: str) -> str:
    return f"(1 - {_E2!r}) * ({s} / (1 - {_E2!r} * {s} * {s}) + atanh({math.sqrt(_E2)!r} * {s}) / {math.sqrt(_E2)!r})"


#: The forward projection, from which the query's inverse must come back.
_LAEA = f"""k AS (SELECT {_area("1.0::DOUBLE")} AS qp, {_area("sin(radians(52.0::DOUBLE))")} AS q0),
l1 AS (SELECT *, asin(q0 / qp) AS b0, 6378137.0 * sqrt(qp / 2) AS rq FROM k),
l2 AS (SELECT *, 6378137.0 * cos(radians(52.0::DOUBLE)) / sqrt(1 - {_E2!r} * sin(radians(52.0::DOUBLE)) ** 2) / (rq * cos(b0)) AS d FROM l1),
l3 AS (SELECT p.*, l2.*, asin({_area("sin(radians(lat))")} / qp) AS b, radians(lon - 10) AS m FROM p, l2),
l4 AS (SELECT *, rq * sqrt(2 / (1 + sin(b0) * sin(b) + cos(b0) * cos(b) * cos(m))) AS bb FROM l3),
l5 AS (SELECT node, lon, lat, 4321000 + bb * d * cos(b) * sin(m) AS east, 3210000 + bb / d * (cos(b0) * sin(b) - sin(b0) * cos(b) * cos(m)) AS north FROM l4)"""


def _laea_forward(rows: DataFrame) -> DataFrame:
    e = math.sqrt(_E2)
    area = lambda s: (1 - _E2) * (s / (1 - _E2 * s * s) + math.atanh(e * s) / e)
    qp, lat0 = area(1.0), math.radians(52.0)
    b0, rq = math.asin(area(math.sin(lat0)) / qp), 6378137.0 * math.sqrt(qp / 2)
    d = 6378137.0 * math.cos(lat0) / math.sqrt(1 - _E2 * math.sin(lat0) ** 2) / (rq * math.cos(b0))
    s = F.sin(F.radians("lat"))
    b, m = F.asin((1 - _E2) * (s / (1 - _E2 * s * s) + F.atanh(e * s) / e) / qp), F.radians(F.col("lon") - 10)
    bb = rq * F.sqrt(2 / (1 + math.sin(b0) * F.sin(b) + math.cos(b0) * F.cos(b) * F.cos(m)))
    return rows.withColumns({"east": 4321000 + bb * d * F.cos(b) * F.sin(m), "north": 3210000 + bb / d * (math.cos(b0) * F.sin(b) - math.sin(b0) * F.cos(b) * F.cos(m))})


@query(f"WITH {_PLACES}, {_LAEA}, {_utm_sql('l5', 32)} SELECT node, round(lon, 7) AS lon, round(lat, 7) AS lat, round(x, 2) AS x, round(y, 2) AS y FROM u4")
def european_grid_to_utm(spark, sf_dir):
    lon, lat = terrain.laea_europe(F.col("east"), F.col("north"))
    back = _laea_forward(_places(spark, sf_dir)).select("node", lon.alias("lon"), lat.alias("lat"))
    x, y = terrain.utm(F.col("lon"), F.col("lat"), 32)
    return back.select("node", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"), F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


# files, headers and tables ----------------------------------------------------------------------------------------


@query("SELECT DISTINCT 'scene_' || strftime(o_orderdate, '%Y%m%d') || '_' || (o_custkey % 3) || '.tif' AS path, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def dated_files(spark, sf_dir):
    name = F.concat(F.lit("scene_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), (F.col("o_custkey") % 3).cast("string"), F.lit(".tif"))
    return readers.dated(table(spark, sf_dir, "orders").select(name.alias("path")).distinct()).withColumn("day", F.col("day").cast("string"))


@query("SELECT column_name AS name, row_number() OVER (ORDER BY column_name) AS position FROM (DESCRIBE lineitem)")
def sorted_header(spark, sf_dir):
    """The columns of a table by name, from its schema alone."""
    names = sorted(table(spark, sf_dir, "lineitem").columns)
    return spark.createDataFrame([(n, k) for k, n in enumerate(names, 1)], "name string, position long")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders WHERE o_orderdate >= DATE '1995-07-04' AND o_orderdate <= DATE '1997-12-25' GROUP BY 1")
def time_window(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where(F.to_date("o_orderdate").between("1995-07-04", "1997-12-25"))
    return rows.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


_DIGEST = "CASE p_partkey % 4 WHEN 0 THEN sha256(p_name) WHEN 1 THEN upper(sha256(p_name)) WHEN 2 THEN substr(sha256(p_name), 2) ELSE 'g' || substr(sha256(p_name), 2) END"


@query(f"SELECT p_partkey, regexp_full_match(lower({_DIGEST}), '[0-9a-f]{{64}}') AS good FROM part")
def digest_format(spark, sf_dir):
    h, k = F.sha2("p_name", 256), F.col("p_partkey") % 4
    given = F.when(k == 0, h).when(k == 1, F.upper(h)).when(k == 2, F.substring(h, 2, 64)).otherwise(F.concat(F.lit("g"), F.substring(h, 2, 64)))
    return table(spark, sf_dir, "part").select("p_partkey", is_sha256(given).alias("good"))


@query("SELECT n_nationkey, n_name, pos AS position FROM (VALUES (12, 0), (2, 1), (14, 2), (6, 3)) v(k, pos) JOIN nation ON n_nationkey = k")
def ordered_lookup(spark, sf_dir):
    return audits.ordered(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey", [12, 2, 14, 6])


@query("SELECT (SELECT count(*) FROM lineitem) AS n_rows, count(*) AS n_keys, count(CASE WHEN n > 1 THEN 1 END) AS repeated, CAST(0 AS BIGINT) AS n_null FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_suppkey)")
def key_uniqueness(spark, sf_dir):
    return audits.repeats(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


@query("SELECT DISTINCT o_orderpriority = '1-URGENT' AS used, CASE o_orderstatus WHEN 'F' THEN 'evaluation' WHEN 'O' THEN 'selection' ELSE 'model_construction' END AS purpose, o_orderpriority <> '1-URGENT' OR o_orderstatus = 'F' AS allowed FROM orders")
def inventory_use(spark, sf_dir):
    s = F.col("o_orderstatus")
    uses = table(spark, sf_dir, "orders").select((F.col("o_orderpriority") == "1-URGENT").alias("used"), F.when(s == "F", "evaluation").when(s == "O", "selection").otherwise("model_construction").alias("purpose"))
    return audits.inventory_uses(uses.distinct())


@query("SELECT l_orderkey AS node, l_linenumber AS e, max(l_discount) > 0.02 AS valid, CASE WHEN l_linenumber < 5 THEN max(l_quantity) * 2 END AS value FROM lineitem GROUP BY 1, 2")
def replaced_values(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("node"), F.col("l_linenumber").alias("e"))
    rows = cells.agg((F.max("l_discount") > 0.02).alias("valid"), F.max("l_extendedprice").alias("value"), (F.max("l_quantity") * 2).alias("new"))
    return audits.with_values(rows.drop("new"), rows.where("e < 5").select("node", "e", F.col("new").alias("value")))


@query("""WITH e AS (SELECT ps.s_suppkey AS src, ps.s_suppkey + 1 AS dst, ps.s_acctbal AS w FROM supplier ps)
SELECT 0 AS bad_values, (SELECT count(*) FROM supplier WHERE s_acctbal <= 0) AS bad_fidelity, (SELECT count(*) FROM e WHERE dst NOT IN (SELECT s_suppkey FROM supplier)) AS unknown_ends, 0 AS loops, (SELECT count(*) FROM e WHERE w < 0) AS bad_weights""")
def solver_input_guard(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    nodes = s.select(F.col("s_suppkey").alias("node"), F.array(F.col("s_acctbal"), F.col("s_nationkey").cast("double")).alias("z"), F.col("s_acctbal").alias("rho"))
    return audits.solver_inputs(nodes, s.select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") + 1).alias("dst"), F.col("s_acctbal").alias("omega")))


@query("SELECT site, method, fdd, rank() OVER (PARTITION BY site ORDER BY fdd) AS rank_fdd FROM (SELECT n_name AS site, c_mktsegment AS method, round(avg(c_acctbal), 4) AS fdd FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)")
def ranked_table(spark, sf_dir):
    """A result table written as CSV and read again, then ranked."""
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.groupBy(F.col("n_name").alias("site"), F.col("c_mktsegment").alias("method")).agg(F.round(F.avg("c_acctbal"), 4).alias("fdd"))
    path = sinks.scratch(spark, "ranked")
    sinks.write_table(rows, path, ["site", "method"])
    read = readers.read_results(spark, path, "site string, method string, fdd double")
    return metrics.ranked(read, "site", "fdd")


# diagnostics of a realization -------------------------------------------------------------------------------------

_CENTRES = "c AS (SELECT label, [{}] AS c FROM v GROUP BY label)".format(", ".join(f"avg(z[{k}])" for k in range(1, 65)))


@query(f"""WITH v AS (SELECT vec_id AS node, CAST(embedding AS DOUBLE[]) AS z, label FROM embeddings), {_CENTRES},
g AS (SELECT min(sqrt(list_sum(list_transform(list_zip(a.c, b.c), lambda p: (p[1] - p[2]) ** 2)))) AS gap FROM c a JOIN c b ON b.label = a.label + 1),
w AS (SELECT sqrt(avg(list_sum(list_transform(list_zip(v.z, c.c), lambda p: (p[1] - p[2]) ** 2)))) AS spread FROM v JOIN c USING (label))
SELECT round(gap / spread, 6) AS separability FROM g, w""")
def zone_separability(spark, sf_dir):
    return metrics.separability(vectors(spark, sf_dir), 64).select(F.round("separability", 6).alias("separability"))


@query("""WITH s AS (SELECT s_suppkey AS node, s_suppkey % 10 AS x, s_suppkey // 10 AS y, s_nationkey % 3 AS label FROM supplier),
e AS (SELECT a.node AS src, b.node AS dst, a.label AS l, b.label AS m FROM s a JOIN s b ON (b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1))
SELECT count(*) AS edges, count(CASE WHEN l <> m THEN 1 END) AS boundary_edges FROM e""")
def boundary_edge_counts(spark, sf_dir):
    s = sites(spark, sf_dir).select("node", "x", "y")
    ahead = s.select(F.col("node").alias("src"), F.explode(F.array(F.struct((F.col("x") + 1).alias("x"), "y"), F.struct("x", (F.col("y") + 1).alias("y")))).alias("p"))
    links = ahead.select("src", "p.x", "p.y").join(s.withColumnRenamed("node", "dst"), ["x", "y"]).select("src", "dst")
    labels = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), (F.col("s_nationkey") % 3).alias("label"))
    return metrics.boundary_counts(links, labels)
