"""Command line: list and run registered queries, or read and check an event source.

    python -m marketloom.cli list
    python -m marketloom.cli run NAME --data DIR [--out DIR] [--limit N]
    python -m marketloom.cli check PATH
    python -m marketloom.cli report --data DIR --out FILE
    python -m marketloom.cli research PATH --lead ID --follow ID --out DIR [--config FILE]
    python -m marketloom.cli strategy PATH --name auction|failed_breakout|failed_gap --lead ID --follow ID --out DIR [--config FILE]
    python -m marketloom.cli days PATH --out DIR [--interval NS]
    python -m marketloom.cli behavior PATH --out DIR [--science]
    python -m marketloom.cli period DIR --out DIR
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import ship
from .operators import research
from .plans import behavior_run, catalogue, strategies, unified
from .sources import mbo


def _report(spark: SparkSession, data: str) -> str:
    """Evidence from the registered research queries as Markdown."""
    store, findings = research.EvidenceStore(), []
    for r in catalogue.QUERIES["signal_screen"](spark, data).collect():
        store.add(research.Evidence(f"ic:{r.signal}", "ic", float(r.ic), float(r.adjusted)))
        findings.append(research.Finding(f"{r.signal} predicts the next return", (f"ic:{r.signal}",)))
    for r in catalogue.QUERIES["coverage_metrics"](spark, data).collect():
        store.add(research.Evidence(f"coverage:{r.metric}", r.metric, float(r.value), r.pvalue))
        if r.triggered:
            findings.append(research.Finding(f"features miss structure by {r.metric} ({r.severity})", (f"coverage:{r.metric}",), r.pvalue is not None))
    return research.report("Research report", store, findings)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="marketloom")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("name", choices=sorted(catalogue.QUERIES))
    run.add_argument("--data", required=True)
    run.add_argument("--out")
    run.add_argument("--limit", type=int, default=20, help="rows to show when nothing is written")
    check = sub.add_parser("check")
    check.add_argument("path")
    rep = sub.add_parser("report")
    rep.add_argument("--data", required=True)
    rep.add_argument("--out", required=True)
    res = sub.add_parser("research")
    res.add_argument("path")
    res.add_argument("--lead", type=int, required=True)
    res.add_argument("--follow", type=int, required=True)
    res.add_argument("--out", required=True)
    res.add_argument("--config")
    plan = sub.add_parser("strategy")
    plan.add_argument("path")
    plan.add_argument("--name", choices=sorted(strategies.FOCUS), required=True)
    plan.add_argument("--lead", type=int, required=True)
    plan.add_argument("--follow", type=int, required=True)
    plan.add_argument("--out", required=True)
    plan.add_argument("--config")
    days = sub.add_parser("days")
    days.add_argument("path")
    days.add_argument("--out", required=True)
    days.add_argument("--interval", type=int, default=60_000_000_000)
    beh = sub.add_parser("behavior")
    beh.add_argument("path")
    beh.add_argument("--out", required=True)
    beh.add_argument("--science", action="store_true")
    per = sub.add_parser("period")
    per.add_argument("path")
    per.add_argument("--out", required=True)
    args = parser.parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(catalogue.QUERIES)))
        return 0
    spark = ship(SparkSession.builder.appName("marketloom").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    if args.command == "run":
        df = catalogue.QUERIES[args.name](spark, args.data)
        df.write.mode("overwrite").parquet(args.out) if args.out else df.show(args.limit, truncate=False)
    elif args.command == "research":
        cfg = unified.RunConfig.read(args.config) if args.config else unified.RunConfig()
        print("\n".join(unified.run(spark, mbo.read(spark, args.path), args.lead, args.follow, args.out, cfg).values()))
    elif args.command == "strategy":
        cfg = strategies.StrategyConfig(run=unified.RunConfig.read(args.config) if args.config else unified.RunConfig(), strategy=args.name)
        print("\n".join(strategies.run(spark, mbo.read(spark, args.path), args.lead, args.follow, args.out, cfg).values()))
    elif args.command == "days":
        print("\n".join(strategies.run_days(spark, mbo.read(spark, args.path), args.out, args.interval).values()))
    elif args.command == "behavior":
        made = behavior_run.analyse(mbo.read(spark, args.path), out_dir=args.out)
        tables = {"states": made.states(), "events": made.events, "rates": made.rates, "sessions": made.sessions, "scenarios": made.scenarios}
        paths = behavior_run.write_tables(spark, tables, args.out, "Behaviour analysis")
        if args.science:
            paths |= behavior_run.write_science(spark, behavior_run.run_science(made.blended), f"{args.out}/science")
        print("\n".join(paths.values()))
    elif args.command == "period":
        print("\n".join(behavior_run.run_period(spark, args.path, args.out).values()))
    elif args.command == "report":
        with open(args.out, "w", encoding="utf-8") as out:
            out.write(_report(spark, args.data))
    else:
        df = mbo.read(spark, args.path)
        mbo.contract_counts(df).show(truncate=False)
        mbo.integrity(df).withColumn("clean", (F.col("n_non_monotonic") == 0)).show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
