"""python -m quillspark report SPEC --base DIR --licenses FILE --out DIR: the evaluation report of a specification."""

from __future__ import annotations

import argparse
import shlex
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from quillspark.plans.evaluation import Spec, build_report, read_inputs, write_report
from quillspark.provenance import run_context
from quillspark.sources.files import read_licenses


def report(spark: SparkSession, spec: str, base: str, licenses: str, out: str, command: str | None = None) -> tuple[str, str]:
    """Read what the specification names below base, score it and write the report; returns its two paths."""
    told = Spec.parse(Path(spec).read_text(encoding="utf-8"))
    registry = read_licenses(spark, Path(licenses).read_text(encoding="utf-8"), "json" if licenses.endswith(".json") else "toml")
    segments, predictions, training, paths = read_inputs(spark, told, base)
    context = run_context(told.seed, {"report": told.name, "n_resamples": told.n_resamples}, command, folder=base)
    return write_report(build_report(told, segments, predictions, registry, context, training), out, (spec, licenses, *paths))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillspark", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("report")
    one.add_argument("spec")
    for name in ("--base", "--licenses", "--out"):
        one.add_argument(name, required=True)
    given = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    command = shlex.join(["python", "-m", "quillspark", *(sys.argv[1:] if argv is None else argv)])
    try:
        print(*report(spark, given.spec, given.base, given.licenses, given.out, command), sep="\n")
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
