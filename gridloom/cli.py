"""Command line: ``python -m gridloom.cli dump FILE`` and ``report FILE``."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from .operators import rules as R
from .operators import tiers as T
from .plans import report as P
from .sources import xlsx


def session() -> SparkSession:
    spark = SparkSession.builder.appName("gridloom").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def dump(path: str) -> str:
    """A workbook's tables as JSON, read without Spark."""
    xlsx.check_suffix(path)
    with open(path, "rb") as f:
        data = f.read()
    name = os.path.splitext(os.path.basename(path))[0]
    from .sources import schema

    kinds = {"cells": schema.CELLS, "named_ranges": schema.NAMED_RANGES, "skipped": schema.SKIPPED, "merged": schema.MERGED}
    out = {t: [dict(zip((p.split()[0] for p in kind.split(", ")), r)) for r in xlsx.workbook_rows(name, data, t)] for t, kind in kinds.items()}
    return json.dumps({"workbook": name, **out}, indent=1, ensure_ascii=False, default=str)


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="gridloom")
    commands = top.add_subparsers(dest="command", required=True)
    d = commands.add_parser("dump", help="cells, names and skip log as JSON")
    d.add_argument("workbook")
    d.add_argument("-o", "--output")
    r = commands.add_parser("report", help="ranked issues")
    r.add_argument("workbook")
    r.add_argument("--json")
    r.add_argument("--html")
    r.add_argument("--tier1", help="folder of a trained classifier")
    r.add_argument("--tier2", action="store_true", help="ask a local chat model about what tier 1 leaves")
    args = top.parse_args(argv)
    if args.command == "dump":
        text = dump(args.workbook)
        if args.output:
            with open(args.output, "w", encoding="utf-8") as out:
                out.write(text)
        else:
            print(text)
        return 0
    xlsx.check_suffix(args.workbook)
    if args.tier2 and not args.tier1:
        raise ValueError("tier 2 reviews what tier 1 leaves: it needs --tier1")
    spark = session()
    path = "file://" + os.path.abspath(args.workbook)
    a = R.analyze(xlsx.read_workbooks(spark, path), xlsx.read_workbooks(spark, path, "named_ranges"))
    if args.tier2:
        T.check_available()
    model = T.load(args.tier1) if args.tier1 else None
    stem = os.path.splitext(os.path.basename(args.workbook))[0]
    found = P.build(a, stem, model[0] if model else None, T.ask if args.tier2 else None)
    if model:
        found.caveat += " " + T.confidence_caveat(model[2])
    if args.json:
        with open(args.json, "w", encoding="utf-8") as out:
            out.write(found.to_json())
    if args.html or not args.json:
        with open(args.html or f"{stem}.report.html", "w", encoding="utf-8") as out:
            out.write(P.render_html(found))
    print(f"{len(found.issues)} issues, {len(found.suppressed_issues)} suppressed")
    return 0


if __name__ == "__main__":
    sys.exit(main())
