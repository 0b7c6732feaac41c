"""``python -m lumenguard.cli scan [--json | --quiet] [file ...]``: exit code 0 clean, 1 findings, 2 errors or incomplete."""

from __future__ import annotations

import argparse
import os
import stat
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sources
from .operators import report
from .operators.classify import classify, input_verdict, worst_verdict


def scanned(inputs: DataFrame) -> DataFrame:
    """Inputs without bytes are listed as EMPTY and don't count for the verdict."""
    done = classify(inputs, "text")
    return done.withColumn("verdict", F.when(F.col("length") == 0, "EMPTY").otherwise(input_verdict(F.col("result"))))


def unread_stdin() -> str | None:
    """What standard input holds when only files are named, told without reading: ``content`` of a file, or a ``stream``."""
    try:
        mode = os.fstat(0)
    except OSError:
        return None
    if stat.S_ISREG(mode.st_mode):
        return "content" if mode.st_size else None
    return "stream" if stat.S_ISFIFO(mode.st_mode) or stat.S_ISSOCK(mode.st_mode) else None


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lumenguard")
    parser.add_argument("command", choices=["scan"])
    parser.add_argument("files", nargs="*")
    how = parser.add_mutually_exclusive_group()
    how.add_argument("--json", action="store_true")
    how.add_argument("--quiet", "-q", action="store_true")
    a = parser.parse_intermixed_args(args)
    spark = SparkSession.builder.appName("lumenguard").getOrCreate()
    named = [f for f in a.files if f != "-"]
    try:
        if named and "-" not in a.files:
            if (held := unread_stdin()) == "content":
                raise sources.UsageError("standard input has content, but only files are named; add '-' to scan it, too")
            if held == "stream":
                print("lumenguard: standard input is not read, as files are named", file=sys.stderr)
        for f in named:
            sources.refuse_unreadable(f)
        inputs = sources.files(spark, named) if named else None
        if not named or "-" in a.files:
            own = sources.text(spark, sys.stdin.read())
            inputs = own if inputs is None else inputs.unionByName(own)
        done = scanned(inputs).cache()
        used = done.where("verdict <> 'EMPTY'")
        if used.isEmpty():
            raise sources.UsageError("no input")
        worst = worst_verdict(used).first()
        if a.quiet:
            print(worst["verdict"])
        else:
            texts = [r["json"] for r in report.json_rows(done.orderBy("path"), "path", "length", "text", "result").toLocalIterator()]
            print("\n".join(texts) if a.json else report.human_from_json(texts, worst["verdict"]))
        return worst["exit_code"]
    except Exception as e:  # noqa: BLE001  whatever it is, the exit code says that there is no answer
        print(f"lumenguard: {str(e).splitlines()[0]}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
