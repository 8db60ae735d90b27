"""python -m gridloom.cli clean FILE [-o OUT] [-s STRATEGY] [--sheet S] [--shape long] [-t TABLE] | detect FILE [--sheet S] | --version"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from gridloom import __version__
from gridloom.pipeline import Pipeline
from gridloom.sources.sinks import save_dataframe

PREVIEW = 20


def sheet_of(value: str | None) -> str | int | None:
    """Digits are a sheet's place, anything else its name."""
    return int(value) if value and value.lstrip("-").isdigit() else value


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gridloom")
    parser.add_argument("--version", action="version", version=f"gridloom {__version__}")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("clean", "detect"):
        sub = commands.add_parser(name)
        sub.add_argument("file")
        sub.add_argument("-s", "--strategy")
        sub.add_argument("--sheet", type=sheet_of)
    clean = commands.choices["clean"]
    clean.add_argument("-o", "--output")
    clean.add_argument("--shape", choices=("wide", "long"), default="wide")
    clean.add_argument("-t", "--table", type=int, default=0)
    args = parser.parse_args(argv)
    with Pipeline(args.file, spark=SparkSession.builder.getOrCreate(), strategy=args.strategy, sheet_name=args.sheet) as p:
        tables = p.detect().clean().all_tables()
        if args.command == "detect":
            print(f"{len(tables)} table(s) detected in {args.file}:")
            for i, t in enumerate(tables):
                print(f"  [{i}] {t.count()} rows x {len(t.columns)} cols: {', '.join(t.columns[:8])}{' ...' if len(t.columns) > 8 else ''}")
            return 0
        if not tables:
            print(f"No table detected in {args.file}.", file=sys.stderr)
            return 1
        if not 0 <= args.table < len(tables):
            parser.error(f"--table {args.table} is out of range, {len(tables)} table(s) found")
        out = p.to_long(args.table).result() if args.shape == "long" else tables[args.table]
        if args.output:
            save_dataframe(out, args.output)
        else:
            out.show(PREVIEW, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
