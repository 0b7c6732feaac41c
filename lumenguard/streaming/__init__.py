"""The same classification on streams, and counts of findings by windows of time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import registry as R
from ..operators.classify import classify


def classified(stream: DataFrame, text: str) -> DataFrame:
    """All work is in the row, so there is no state."""
    return classify(stream, text)


def windowed_counts(stream: DataFrame, text: str, ts: str, window: str, late: str) -> DataFrame:
    """(window, type, n); rows later than ``late`` behind the newest are left out, and state goes with their windows."""
    rows = classify(stream.withWatermark(ts, late), text).select(ts, F.explode("result.violations.type").alias("type"))
    return rows.groupBy(F.window(ts, window), "type").agg(F.count(F.lit(1)).alias("n"))


def with_registry(stream: DataFrame, text: str, package: str, load: Callable[[], R.Registry], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch reads the registry's tables anew, so none is older than a batch; ``sink`` gets the batch and its number."""

    def one(batch: DataFrame, number: int) -> None:
        done = R.lookup(classify(batch, text), package, load())
        after = R.apply(F.col("result.verdict"), F.col("result.violations"), F.col("lookup"), F.col(package), F.lit(None).cast("int"), F.lit(None).cast("string"))
        sink(done.withColumn("decision", after), number)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
