"""python -m rivulet run FILE | analyze FILE; without FILE the program is read from standard input."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from rivulet.plans.analysis import analyze
from rivulet.plans.bounds import BoundsError
from rivulet.plans.parser import ParseError


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rivulet", description="Pipelines over finite, ordered streams on Spark.")
    parser.add_argument("command", choices=("run", "analyze"), nargs="?", default="run")
    parser.add_argument("file", nargs="?")
    parser.add_argument("--master", default=None, help="the Spark master, if no session is configured")
    parser.add_argument("--wrap-overflow", action="store_true", help="integers wrap around instead of stopping the program")
    given = list(sys.argv[1:] if args is None else args)
    if given and given[0] not in ("run", "analyze", "-h", "--help"):
        given.insert(0, "run")
    options = parser.parse_args(given)
    try:
        text = (Path(options.file).read_text() if options.file else sys.stdin.read()).strip()
        if options.command == "analyze":
            print(analyze(text).json())
            return 0
        from pyspark.sql import SparkSession

        from rivulet.engine import ProgramError, run

        builder = SparkSession.builder.appName("rivulet")
        spark = (builder.master(options.master) if options.master else builder).getOrCreate()
        try:
            out = run(text, spark, wrap_overflow=options.wrap_overflow)
            if out is not None:  # returned items are printed as a file would hold them
                out.write_file("/dev/stdout")
        except ProgramError as e:
            print(f"rivulet: {e}", file=sys.stderr)
            return 1
    except (ParseError, BoundsError, OSError) as e:
        print(f"rivulet: {e}", file=sys.stderr)
        return 1
    return 0
