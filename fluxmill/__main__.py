"""Command line: ``python -m fluxmill validate|setup|run|schedule|last-error|sql|report --root DIR [--target dev] [name=value ...]``."""

from __future__ import annotations

import argparse
import sys

from fluxmill.config import TARGETS, Env
from fluxmill.plans.migrate import EVERYTHING, discover
from fluxmill.plans.statements import render, split_statements


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="fluxmill", description=__doc__)
    parser.add_argument("action", choices=["validate", "setup", "run", "schedule", "last-error", "sql", "report"])
    parser.add_argument("--root", required=True, help="folder that driver and executors share")
    parser.add_argument("--target", default="dev", choices=sorted(TARGETS))
    parser.add_argument("--migrate-through", default=EVERYTHING)
    parser.add_argument("--max-files", type=int, help="landing files of a micro-batch")
    parser.add_argument("--max-bytes", type=int, help="bytes of landing files of a micro-batch")
    parser.add_argument("--sql", help="a statement, or the name of a verification query")
    parser.add_argument("params", nargs="*", help="name=value, overriding the target's values")
    args = parser.parse_args(argv)
    env = Env.from_params(args.root, {"schema": args.target, **dict(p.split("=", 1) for p in args.params)})
    if args.action == "validate":
        for m in discover():
            print(f"{m.filename}: {len(split_statements(render(m.text, env.substitutions())))} statements")
        return 0

    from pyspark.sql import SparkSession

    from fluxmill.plans import jobs, verify

    spark = SparkSession.builder.appName("fluxmill").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.action == "sql":
        verify.query(spark, env, args.sql or "medallion_counts").show(100, truncate=False)
        return 0
    if args.action == "report":
        print(verify.report(spark, env))
        return 0
    if args.action == "last-error":
        found = jobs.last_error(spark, env)
        print("no failed run is stored" if found is None else "\n".join(f"{k}: {v}" for k, v in found.items()))
        return 0

    def medallion() -> list[jobs.Outcome]:
        return show(jobs.medallion_job(spark, env, args.migrate_through, args.max_files, args.max_bytes))

    def show(outcomes: list[jobs.Outcome]) -> list[jobs.Outcome]:
        for o in outcomes:
            print(f"{o.task:10} {o.state:8} {o.seconds:6.1f} s  {o.result if o.state == 'done' else o.cause}", flush=True)
        return outcomes

    if args.action == "schedule":
        jobs.run_scheduled(env, medallion)
        return 0
    outcomes = show(jobs.setup_job(spark, env, args.migrate_through)) if args.action == "setup" else medallion()
    return int(jobs.last_failure(outcomes) is not None)


if __name__ == "__main__":
    sys.exit(main())
