"""Connected components of a link table, by alternating star steps over the links alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import staged

MOST_ROUNDS = 60


def large_star(links: DataFrame) -> DataFrame:
    """Ties each larger neighbour of u to the least of u and its neighbours."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Ties u and its smaller neighbours to the least of them; ``links`` have u > v."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all ids in ``links`` (u, v), component being the least id reachable.

    Each round is written to the shared folder; rounds are about the logarithm of the longest path. Nothing but a count and
    a checksum comes to the driver. Null ends are dropped, repeated and reversed links count once, and an empty table has no ids.
    """
    now = staged(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    mark = None
    for _ in range(MOST_ROUNDS):
        row = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if row["n"] == 0 or (row["n"], row["s"]) == mark:
            break
        mark = (row["n"], row["s"])
        now = staged(small_star(large_star(now)), "links")
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
