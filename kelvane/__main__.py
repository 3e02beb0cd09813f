"""``python -m kelvane ingest|validate|stats|doctor``: exit code 0 for done, 1 for findings, 2 for broken input, 3 for a wrong row balance."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime

from pyspark.sql import SparkSession

from kelvane.config import MIN_CONFIDENCE, BalanceError, IngestError, SchemaError
from kelvane.functions.vocab import DEFAULT, Vocabulary
from kelvane.operators import profile as P
from kelvane.operators import quality as Q
from kelvane.plans.ingest import health, ingest
from kelvane.sources.workbook import WorkbookStore, latest_workbook
from kelvane.sources.xlsx import read_master


def run_ingest(spark: SparkSession, args) -> int:
    now = datetime.now()
    store = WorkbookStore(spark, args.db, args.out_dir, stamp=now.strftime("%y%m%d"))
    out = ingest(spark, store, args.records, out_dir=args.out_dir, stamp=now.strftime("%Y%m%d_%H%M%S"), today=now.strftime("%Y-%m-%d"), vocabulary=Vocabulary.load(args.vocabulary), version=args.version, min_confidence=args.min_confidence, dry_run=args.dry_run)
    if out.plan:
        print(*(f"{k}: {v}" for k, v in out.plan.summary().first().asDict().items()), sep="\n")
    print(out.report or ("dry run, nothing written" if args.dry_run else "nothing to do"))
    return out.code


def run_validate(spark: SparkSession, args) -> int:
    table = read_master(spark, args.db)
    issues = Q.validate(table, Vocabulary.load(args.vocabulary), strict=args.strict).cache()
    print(Q.render(issues, Q.stats(table)))
    return 0 if Q.errors(issues).isEmpty() else 1


def run_stats(spark: SparkSession, args) -> int:
    print(P.render(read_master(spark, args.db).cache(), args.db))
    return 0


def run_doctor(spark: SparkSession, args) -> int:
    state = health(spark) | {"workbook": latest_workbook(spark, args.folders)}
    print(*(f"{k}: {v}" for k, v in state.items()), sep="\n")
    return 0 if state["vocabulary"] else 1


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kelvane")
    sub = p.add_subparsers(dest="command", required=True)
    commands = {}
    for name, fn in (("ingest", run_ingest), ("validate", run_validate), ("stats", run_stats), ("doctor", run_doctor)):
        commands[name] = sub.add_parser(name)
        commands[name].set_defaults(run=fn)
        if name != "doctor":
            commands[name].add_argument("--db", required=True, help="the workbook")
        if name in ("ingest", "validate"):
            commands[name].add_argument("--vocabulary", default=DEFAULT)
    commands["ingest"].add_argument("records", help="the batch, a JSON file")
    commands["ingest"].add_argument("--out-dir", default="data/outputs")
    commands["ingest"].add_argument("--min-confidence", type=float, default=MIN_CONFIDENCE)
    commands["ingest"].add_argument("--version")
    commands["ingest"].add_argument("--dry-run", action="store_true")
    commands["validate"].add_argument("--strict", action="store_true")
    commands["doctor"].add_argument("folders", nargs="*", default=["data/outputs", "data"])
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("kelvane").getOrCreate()
    try:
        return args.run(spark, args)
    except BalanceError as e:
        print(e)
        return 3
    except (IngestError, SchemaError, FileNotFoundError) as e:
        print(e)
        return 2


if __name__ == "__main__":
    sys.exit(main())
