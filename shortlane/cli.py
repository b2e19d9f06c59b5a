"""Command line: validate a shortlist file, or rank candidates into one."""

from __future__ import annotations

import argparse
import errno
import os
import sys
from pathlib import PurePath

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import SparkSession

from shortlane.operators import validate
from shortlane.operators.shortlist import rank_profiles
from shortlane.sources import candidates, csv_parallel, submission

#: Files of more bytes are read in many tasks.
LARGE_FILE = 16 << 20


def validate_file(spark: SparkSession, path: str) -> list[str]:
    """The report of one file, in order; empty if the file is valid."""
    errors = [] if PurePath(path).suffix.lower() == ".csv" else [validate.MESSAGES["extension"]]
    try:
        large = spark.read.format("binaryFile").load(path).where(f"length > {LARGE_FILE}").select("length").first()
        rows = (csv_parallel if large else submission).read_rows(spark, path)
        first = {r["row_ix"]: r for r in rows.where("row_ix < 1").collect()}  # the header and the end of a file that is not UTF-8
        if -1 in first:
            header = [r["message"] for r in validate.header_errors(rows).collect()]
            return [*errors, *header, validate.MESSAGES["encoding"]]
        if 0 not in first:
            return [*errors, validate.MESSAGES["empty"]]
        found = validate.report(rows).orderBy("phase", "row_num", "field").collect()  # a shortlist has about 100 rows
    except AnalysisException as e:
        missing = FileNotFoundError(errno.ENOENT, os.strerror(errno.ENOENT), path)
        return [*errors, validate.MESSAGES["unreadable"].format(missing if e.getCondition() == "PATH_NOT_FOUND" else str(e).splitlines()[0])]
    except PySparkException as e:  # a cell longer than the csv module reads
        return [*errors, validate.MESSAGES["unreadable"].format(str(e).splitlines()[0])]
    return [*errors, *(r["message"] for r in found)]


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if argv[:1] == ["validate"] and len(argv) != 2:
        print("Usage: python -m shortlane.cli validate <participant_id>.csv")
        return 1
    parser = argparse.ArgumentParser(prog="shortlane")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("validate")
    one.add_argument("path")
    two = commands.add_parser("rank")
    two.add_argument("--candidates", required=True)
    two.add_argument("--out", required=True)
    two.add_argument("--job", default="", help="text file with the job description")
    two.add_argument("--as-of", default="2025-01-01")
    two.add_argument("--parquet", default="", help="convert the candidates to this folder first, or use it if it is there")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("shortlane").getOrCreate()
    if args.command == "rank":
        job = open(args.job, encoding="utf-8").read() if args.job else ""
        profiles = candidates.profiles(spark, args.candidates, args.parquet)
        submission.write_shortlist(rank_profiles(profiles, job, args.as_of), args.out)
        args.path = args.out
    errors = validate_file(spark, args.path)
    if errors:
        print(f"Validation failed ({len(errors)} issue(s)):\n")
        print("\n".join(f"- {e}" for e in errors))
        return 1
    print("Submission is valid.")
    return 0


if __name__ == "__main__":
    sys.exit(main())
