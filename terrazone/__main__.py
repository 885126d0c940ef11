"""python -m terrazone prepare | run | baseline | controlled | evaluate | rank"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrazone.operators import baselines, experiment, metrics, timeaxis
from terrazone.plans import site
from terrazone.session import session
from terrazone.sources import panels, readers, sinks

LAYOUTS = {"offida": readers.OFFIDA, "mendatica": readers.MENDATICA, "zhouqu": readers.ZHOUQU}
RESULT = "site string, method string, FDD_mean double, FDD_sample_sd double, FDD_unit string, FI_mean double, FI_sample_sd double, rank_FDD int, rank_FI int, seed_count int"


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="terrazone")
    commands = parser.add_subparsers(dest="command", required=True)
    c = commands.add_parser("prepare", help="a wide dated table to site tables")
    c.add_argument("layout", choices=LAYOUTS)
    c.add_argument("table")
    c.add_argument("--value-scope", choices=["all", "train_only"], default="all")
    c = commands.add_parser("controlled", help="the synthetic experiment: raw rows and their summary")
    c.add_argument("--seeds", type=int, default=20)
    c = commands.add_parser("evaluate", help="scores of labels (node, label) against site tables")
    c.add_argument("site")
    c.add_argument("labels")
    c = commands.add_parser("run", help="zones and scores of a prepared site whose points have coordinates and terrain")
    c.add_argument("site")
    c.add_argument("config", help="JSON settings of the site")
    c.add_argument("--imagery", help="table of node, z_o, q_o")
    c.add_argument("--quality", help="table of node, field, value, direction")
    c.add_argument("--variant", choices=list(experiment.VARIANTS), default="Full")
    c.add_argument("--seed", type=int, default=0)
    c = commands.add_parser("baseline", help="labels by descriptors of the series, or by an equal fusion of three views")
    c.add_argument("method", choices=["descriptors", "views"])
    c.add_argument("site")
    c.add_argument("--views", help="table of node and three arrays: deformation, terrain, imagery")
    c.add_argument("--zones", type=int, required=True)
    c.add_argument("--seed", type=int, default=0)
    c = commands.add_parser("rank", help="a table of results with its ranks checked")
    c.add_argument("table")
    for c in commands.choices.values():
        c.add_argument("--output", required=True)
    args = parser.parse_args(argv)
    spark = session()
    if args.command == "prepare":
        points, observed = readers.read_wide(spark, args.table, LAYOUTS[args.layout], args.value_scope)
        # the points of one site, numbered in order of their ids
        numbered = points.withColumn("node", (F.row_number().over(Window.orderBy("point_id")) - 1).cast("long"))
        grid = panels.grid(observed.join(numbered.select("point_id", "node"), "point_id").select("node", "t", "value"))
        sinks.write_site(numbered, grid, grid.select("e", "years", "period").distinct(), args.output)
    elif args.command == "controlled":
        raw = experiment.run(spark, list(range(args.seeds)))
        raw.write.mode("overwrite").parquet(f"{args.output}/raw")
        rows = spark.read.parquet(f"{args.output}/raw")
        keys = ["subexperiment", "factor_name", "factor_value", "variant", "metric"]
        sinks.write_table(metrics.summary(rows, keys), f"{args.output}/summary", keys)
    elif args.command == "evaluate":
        obs = spark.read.parquet(f"{args.site}/obs")
        found = site.evaluate(obs, spark.read.parquet(f"{args.site}/points"), spark.read.parquet(args.labels))
        sinks.write_metrics(found, args.output)
    elif args.command == "run":
        settings = readers.read_config(spark, args.config, ["k_s", "lambda", "k_star"])
        obs, points = spark.read.parquet(f"{args.site}/obs"), spark.read.parquet(f"{args.site}/points")
        others = [spark.read.parquet(p) if p else None for p in (args.imagery, args.quality)]
        solver = {n: settings["solver"][o] for n, o in (("max_iters", "max_iters"), ("tol", "tolerance")) if o in settings.get("solver", {})}
        found = site.run(obs, points, int(settings["k_s"]), float(settings["lambda"]), int(settings["k_star"]), *others, variant=args.variant, seed=args.seed, n_init=int(settings.get("clustering", {}).get("n_init", 20)), **solver)
        found.labels.write.mode("overwrite").parquet(f"{args.output}/labels")
        for name in ("z", "rho", "links", "field"):
            getattr(found, name).write.mode("overwrite").parquet(f"{args.output}/{name}")
        sinks.write_metrics(found.metrics, f"{args.output}/metrics")
    elif args.command == "baseline":
        if args.method == "descriptors":
            work = timeaxis.interpolate(timeaxis.admitted(spark.read.parquet(f"{args.site}/obs"), "train"))
            labels = baselines.descriptor_zones(baselines.descriptors(work), args.zones, args.seed)
        else:
            if not args.views:
                parser.error("views need a table of them")
            labels = baselines.view_zones(spark.read.parquet(args.views), args.zones, args.seed)
        labels.write.mode("overwrite").parquet(args.output)
    else:
        rows = readers.read_results(spark, args.table, RESULT)
        ranked = metrics.ranked(rows.drop("rank_FDD", "rank_FI"), "site", "FDD_mean", "FI_mean").withColumnsRenamed({"rank_FDD_mean": "rank_FDD", "rank_FI_mean": "rank_FI"})
        wrong = ranked.join(rows.select("site", "method", F.col("rank_FDD").alias("a"), F.col("rank_FI").alias("b")), ["site", "method"]).where("rank_FDD <> a or rank_FI <> b")
        if not wrong.isEmpty():
            raise ValueError("ranks do not follow from the means")
        sinks.write_table(ranked.select(*rows.columns), args.output, ["site", "rank_FDD"])


if __name__ == "__main__":
    main()
