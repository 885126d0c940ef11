"""Audits as queries: each returns what it checked and what is wrong, and raises only where asked to."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrazone.operators import timeaxis


class LeakageError(ValueError):
    """Something later than the cutoff reached a model."""


class DecisionRequired(ValueError):
    """A unit or sign that only a person can decide was left empty."""


@dataclass(frozen=True)
class Audit:
    stage: str
    source: str
    cutoff: str
    checked: int


def split_audit(epochs: DataFrame) -> DataFrame:
    """One row: periods in order without gaps, each with an epoch, times strictly increasing."""
    w = Window.orderBy("e")
    code = F.when(F.col("period") == "train", 0).when(F.col("period") == "val", 1).otherwise(2)
    rows = epochs.withColumns({"_back": F.coalesce(F.lag("years").over(w) >= F.col("years"), F.lit(False)), "_turn": F.coalesce(F.lag(code).over(w) > code, F.lit(False))})
    return rows.agg(F.count("*").alias("checked"), F.count_if(F.col("_back") | F.col("_turn")).alias("wrong"), F.countDistinct("period").alias("periods"))


def times_audit(rows: DataFrame, t: Column, cutoff: Column) -> DataFrame:
    return timeaxis.late_rows(rows, t, cutoff)


def epochs_audit(used: DataFrame, epochs: DataFrame, stage: str) -> DataFrame:
    """Epochs used that the stage may not see."""
    return used.join(timeaxis.admitted(epochs, stage).select("e"), "e", "left_anti")


def require(found: DataFrame, stage: str, source: str, cutoff: str) -> Audit:
    """Turns a checked/late row into a record, or raises."""
    row = found.first()
    if row["late"]:
        raise LeakageError(f"{row['late']} of {row['checked']} rows of {source} lie after {cutoff}")
    return Audit(stage, source, cutoff, row["checked"])


def validity(obs: DataFrame) -> DataFrame:
    """One row of counts that must all be 0: marked valid without a value, repeated cells, values that are not finite."""
    cells = obs.groupBy("node", "e").agg(F.count("*").alias("_c"), F.count_if(F.col("valid") & F.col("value").isNull()).alias("_v"), F.count_if(F.isnan("value") | (F.abs("value") == float("inf"))).alias("_f"))
    return cells.agg(F.sum("_v").alias("valid_without_value"), F.count_if(F.col("_c") > 1).alias("repeated_cells"), F.sum("_f").alias("not_finite"))


def alignment(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys on one side only."""
    a, b = left.select(F.col(key).alias("k"), F.lit(1).alias("l")).distinct(), right.select(F.col(key).alias("k"), F.lit(1).alias("r")).distinct()
    return a.join(b, "k", "full_outer").agg(F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"))


def support_mask(raster: DataFrame, components: list[str]) -> DataFrame:
    """row, col, invalid, uneven: a cell without support is 0 in every component at every epoch; uneven where its
    components or epochs disagree about that."""
    zero = [F.coalesce(F.col(c) == 0, F.lit(False)) for c in components]
    everywhere, anywhere = zero[0], zero[0]
    for z in zero[1:]:
        everywhere, anywhere = everywhere & z, anywhere | z
    return raster.groupBy("row", "col").agg(F.bool_and(everywhere).alias("invalid"), (F.bool_or(anywhere) & ~F.bool_and(everywhere)).alias("uneven"))


def joint_validity(raster: DataFrame, columns: list[str], share: float = 0.8, nodata: float | None = None) -> DataFrame:
    """row, col, valid, kept: cells with a finite value other than nodata in all columns at no fewer than
    ceil(share * epochs) epochs."""
    good = F.lit(True)
    for c in columns:
        x = F.col(c)
        good = good & x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
        if nodata is not None:
            good = good & (F.abs(x - nodata) > 1e-8 + 1e-5 * abs(nodata))
    total = raster.select("e").distinct().count()
    rows = raster.groupBy("row", "col").agg(F.sum(good.cast("long")).alias("valid"))
    return rows.withColumn("kept", F.col("valid") >= F.ceil(F.lit(share) * total))


def downslope(ve: Column, vn: Column, aspect: Column) -> Column:
    """Horizontal motion along the steepest descent; aspect in degrees clockwise from north."""
    return ve * F.sin(F.radians(aspect)) + vn * F.cos(F.radians(aspect))


def missing_keys(records: DataFrame, payload: str, required: list[str]) -> DataFrame:
    """Adds missing: required top-level keys that a JSON object lacks, sorted."""
    have = F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>"))
    return records.withColumn("missing", F.array_sort(F.array_except(F.array(*map(F.lit, required)), have)))


# process graphs ---------------------------------------------------------------------------------------------------


def graph_tables(spark: SparkSession, graph: Mapping[str, Mapping]) -> tuple[DataFrame, DataFrame]:
    """nodes (node, process, extent) and links (parent, child) of a process graph; references may be nested anywhere."""

    def parents(value) -> set[str]:
        if isinstance(value, Mapping):
            own = {value["from_node"]} if isinstance(value.get("from_node"), str) and value["from_node"] in graph else set()
            return own.union(*(parents(v) for v in value.values()))
        return set().union(*map(parents, value)) if isinstance(value, list | tuple) else set()

    nodes = [(k, v.get("process_id"), [str(x) for x in e] if isinstance(e := v.get("arguments", {}).get("temporal_extent"), list) and all(e) else None) for k, v in graph.items()]
    links = [(p, k) for k, v in graph.items() for p in sorted(parents(v.get("arguments", {})))]
    return spark.createDataFrame(nodes, "node string, process string, extent array<string>"), spark.createDataFrame(links, "parent string, child string")


def ancestors(links: DataFrame) -> DataFrame:
    """child, ancestor: the transitive closure, by doubling until nothing is added. Process graphs are small."""
    now, size = links.select("child", F.col("parent").alias("ancestor")).distinct(), -1
    while (found := now.count()) != size:
        size = found
        step = now.alias("a").join(now.alias("b"), F.col("a.ancestor") == F.col("b.child")).select(F.col("a.child"), F.col("b.ancestor"))
        now = now.union(step).distinct().persist()
    return now


def graph_audit(nodes: DataFrame, links: DataFrame, cutoff: str) -> DataFrame:
    """One row: loads, composites, masks, checked extents, and what is wrong: extents that are open or late, composites
    not below a load, not below a mask or its generator, and whether any is below a mask."""
    up = ancestors(links).join(nodes.select(F.col("node").alias("ancestor"), F.col("process").alias("above")), "ancestor")
    reach = up.groupBy("child").agg(F.bool_or(F.col("above") == "load_collection").alias("load"), F.bool_or(F.col("above") == "mask").alias("masked"), F.bool_or(F.col("above") == "to_scl_dilation_mask").alias("generated"))
    rows = nodes.join(reach, nodes.node == reach.child, "left").select("process", "extent", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("load", "masked", "generated")])
    is_load, is_sum = F.col("process") == "load_collection", F.col("process") == "aggregate_temporal_period"
    late = F.exists(F.col("extent"), lambda x: F.to_timestamp(x) > F.to_timestamp(F.lit(cutoff)))
    return rows.agg(
        F.count_if(is_load).alias("loads"), F.count_if(is_sum).alias("composites"), F.count_if(F.col("process") == "mask").alias("masks"),
        F.coalesce(F.sum(F.when(is_load, F.size("extent"))), F.lit(0)).alias("checked"), F.count_if(is_load & (F.col("extent").isNull() | (F.size("extent") != 2))).alias("open_extents"),
        F.count_if(is_load & F.coalesce(late, F.lit(False))).alias("late_extents"), F.count_if(is_sum & ~F.col("load")).alias("unfiltered"),
        F.count_if(is_sum & ~F.col("masked") & ~F.col("generated")).alias("unmasked"), F.count_if(is_sum & F.col("masked")).alias("masked_composites"),
    )


def accept_graph(spark: SparkSession, graph: Mapping | str, cutoff: str, stage: str = "train") -> Audit:
    nodes, links = graph_tables(spark, json.loads(graph) if isinstance(graph, str) else graph)
    r = graph_audit(nodes, links, cutoff).first()
    if not (r.loads and r.composites and r.masks and r.masked_composites) or r.open_extents or r.late_extents or r.unfiltered or r.unmasked:
        raise LeakageError(f"the process graph does not prove a causal, masked composite: {r.asDict()}")
    return Audit(stage, "optical process graph", cutoff, r.checked)


def optical_source(spark: SparkSession, source: Mapping, cutoff: str, stage: str = "train") -> Audit:
    """Proof that no scene of an optical source is later than the cutoff: the scenes' own times, one for each id, or a
    backend's process graph with its job."""
    if not source.get("provenance_complete"):
        raise LeakageError("the composites come without the ids and times of their scenes")
    times, ids = source.get("acquisition_times") or [], source.get("acquisition_ids") or []
    if not times and source.get("process_graph") is not None:
        if not source.get("job_id"):
            raise LeakageError("the process graph comes without a job")
        return accept_graph(spark, source["process_graph"], cutoff, stage)
    if not times or len(times) != len(ids):
        raise LeakageError("scenes need a time for each id")
    rows = spark.createDataFrame([(str(t),) for t in times], "t string").select(F.to_timestamp("t").alias("t"))
    return require(times_audit(rows, F.coalesce(F.col("t"), F.to_timestamp(F.lit("9999-12-31"))), F.to_timestamp(F.lit(cutoff))), stage, "optical scenes", cutoff)


def inventory_audit(used: bool, purpose: str) -> None:
    """An inventory may judge zones, never make or choose them."""
    if purpose not in ("evaluation", "model_construction", "selection"):
        raise ValueError(f"unknown purpose {purpose}")
    if used and purpose != "evaluation":
        raise LeakageError(f"an inventory may not be used for {purpose}")


def inventory_uses(uses: DataFrame) -> DataFrame:
    """Adds allowed to rows (used, purpose): the same rule as `inventory_audit`."""
    return uses.withColumn("allowed", ~F.col("used") | (F.col("purpose") == "evaluation"))


def with_values(obs: DataFrame, values: DataFrame) -> DataFrame:
    """The observations (node, e, valid, value) with other values (node, e, value), all else and the validity as it was;
    a cell without a new value has none."""
    return obs.drop("value").join(values.select("node", "e", "value"), ["node", "e"], "left").select(*obs.columns)


def ordered(rows: DataFrame, key: str, names: list[str]) -> DataFrame:
    """The rows of the listed keys in the list's order, as `position`; a listed key without a row is an error."""
    listed = rows.sparkSession.createDataFrame([(n, k) for k, n in enumerate(names)], f"{key} {rows.schema[key].dataType.simpleString()}, position int")
    met = F.broadcast(listed).join(rows.withColumn("_in", F.lit(True)), key, "left")
    checked = F.when(F.col("_in"), F.col("position")).otherwise(F.raise_error(F.lit("a listed key has no row")).cast("int"))
    return met.withColumn("position", checked).drop("_in").orderBy("position")


def repeats(rows: DataFrame, *keys: str) -> DataFrame:
    """One row: rows, distinct keys, keys that occur more than once, rows with a null in the key."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    by = rows.withColumn("_null", null).groupBy(*keys).agg(F.count("*").alias("n"), F.bool_or("_null").alias("_null"))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys"), F.count_if(F.col("n") > 1).alias("repeated"), F.coalesce(F.sum(F.when(F.col("_null"), F.col("n"))), F.lit(0)).alias("n_null"))


def solver_inputs(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """One row of counts that must all be 0 before a solver sees its inputs. nodes: node, z, rho; links: src, dst, omega."""
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    width = nodes.agg(F.max(F.size("z")).alias("_d"))
    own = nodes.crossJoin(F.broadcast(width)).agg(
        F.count_if(F.col("z").isNull() | (F.size("z") != F.col("_d")) | (F.size("z") < 1) | F.exists("z", odd)).alias("bad_values"),
        F.count_if(odd(F.col("rho")) | (F.col("rho") <= 0)).alias("bad_fidelity"),
    )
    known = nodes.select(F.col("node").alias("k")).distinct()
    ends = links.select(F.explode(F.array("src", "dst")).alias("k"))
    loose = ends.join(known, "k", "left_anti").agg(F.count("*").alias("unknown_ends"))
    edges = links.agg(F.count_if(F.col("src") == F.col("dst")).alias("loops"), F.count_if(odd(F.col("omega")) | (F.col("omega") < 0)).alias("bad_weights"))
    return own.crossJoin(loose).crossJoin(edges)


#: Records that a site's tables must come with (fixed values).
SITE_RECORDS = ["deformation_observable", "sign_convention", "source_product", "provenance", "quality_metadata_audit", "terrain_provenance", "inventory_audit", "optical_audit"]


def site_records(records: Mapping) -> None:
    if missing := sorted(set(SITE_RECORDS) - set(records)):
        raise ValueError(f"the site lacks the records {missing}")
