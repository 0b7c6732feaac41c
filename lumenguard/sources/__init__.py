"""Files, JSON lines and tables as inputs; reports as outputs."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shown import files_glob, show_string

CASES = "id string, input string, expect struct<types:array<string>,verdict:string,violations:array<struct<type:string,value:string,start:int,end:int,confidence:double,view:string,originalStart:int,originalEnd:int>>>, origin string, fixture string, note string"
CORPUS = "class string, label string, text string, variant string"


PARTS_PER_CORE = 3


class UsageError(ValueError):
    """Nothing to scan."""


def decode_input(content: Column) -> Column:
    """Bytes as text by their byte order mark, which goes; else as UTF-8 with U+FFFD for what is malformed."""
    starts = lambda mark: F.substring(content, 1, len(mark)) == F.lit(mark)
    rest = lambda n: F.substring(content, n + 1, 1 << 30)
    whole = lambda n, unit: F.substring(content, n + 1, ((F.octet_length(content) - n) / unit).cast("int") * unit)
    utf8 = lambda b: F.make_valid_utf8(b.cast("string"))
    wide = lambda n, unit, name: F.decode(whole(n, unit), name)
    return (
        F.when(starts(b"\xff\xfe\x00\x00"), wide(0, 4, "UTF-32"))
        .when(starts(b"\x00\x00\xfe\xff"), wide(0, 4, "UTF-32"))
        .when(starts(b"\xff\xfe"), wide(2, 2, "UTF-16LE"))
        .when(starts(b"\xfe\xff"), wide(2, 2, "UTF-16BE"))
        .when(starts(b"\xef\xbb\xbf"), utf8(rest(3)))
        .otherwise(utf8(content))
    )


def spread(df: DataFrame) -> DataFrame:
    """Rows of files dealt evenly over a few parts for each core, for work that costs more than moving them. How many parts Spark cuts
    a file into tells nothing: one of them reads all rows of a row group, and the others are empty. Inputs of many files stay as they are.
    Parts are not many, as each task takes a few tenths of a second to unpack the expressions of the rule pack, but none is of more bytes
    than Spark would cut from a file, so that a task does not grow with the table."""
    session, read = df.sparkSession, len(df.inputFiles())
    parts = PARTS_PER_CORE * session.sparkContext.defaultParallelism
    if read >= parts:
        return df
    return df.repartition(max(parts, -(-file_bytes(df) // session._jsparkSession.sessionState().conf().filesMaxPartitionBytes())) if read else parts)


def file_bytes(df: DataFrame) -> int:
    """Bytes of the tables that ``df`` reads, as Spark estimates them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(leaves.apply(i).stats().sizeInBytes() for i in range(leaves.size()))


def files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, length, text), one row for each file; a file that can't be read ends the query."""
    if not paths:
        raise UsageError("no input")
    raw = spark.read.format("binaryFile").load(paths)
    empty = spark.createDataFrame([(p, 0, "") for p in empty_files(spark, paths)], "path string, length long, text string")  # which Spark leaves out
    return raw.where("length > 0").select("path", "length", decode_input(F.col("content")).alias("text")).unionByName(empty)


def refuse_unreadable(path: str) -> None:
    """An error with what to do, for a local path that is a folder or may not be read. Other addresses are Spark's to judge."""
    if "://" in path or not os.path.exists(path):
        return
    if os.path.isdir(path):
        raise UsageError(f"{show_string(path, chr(39))} is a directory, and directories are not scanned. Name the files in it: {files_glob(path)}")
    if not os.access(path, os.R_OK):
        raise UsageError(f"cannot read {show_string(path, chr(39))}: permission denied")
    if os.path.getsize(path) >= 1 << 31:
        raise UsageError(f"cannot read {show_string(path, chr(39))}: it is 2 GiB or larger")


def empty_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """Files without a byte among ``paths`` and directly in those that are folders."""
    jvm, conf, found = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        for status in path.getFileSystem(conf).listStatus(path):
            if status.isFile() and status.getLen() == 0 and not status.getPath().getName().startswith(("_", ".")):
                found.append(status.getPath().toString())
    return found


def text(spark: SparkSession, value: str, name: str = "-") -> DataFrame:
    """One text, such as standard input, as a table."""
    return spark.createDataFrame([(name, len(value.encode("utf-8", "surrogatepass")), value)], "path string, length long, text string")


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Expected findings from JSON lines; blank lines are skipped, and equal ids are an error."""
    found = spark.read.schema(CASES).json(path).where(F.col("id").isNotNull())
    if twice := [r["id"] for r in found.groupBy("id").count().where("count > 1").limit(5).collect()]:
        raise ValueError(f"ids occur twice: {', '.join(twice)}")
    return found


def corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CORPUS).json(path)


def write_json(report: DataFrame, path: str) -> None:
    report.write.mode("error").text(path)
