"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")
    ).first()
    return row["n"], row["sum"]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for every node of the undirected edges (u, v); root is the
    smallest node of its component.

    A round is an aggregate (least neighbour of each node) and a join, never a
    list of neighbours, so a node with very many links is no hot group.  Every
    round is written to the shared checkpoint folder; only its row count and a
    checksum reach the driver.
    """
    plain = edges.where(F.col("u") != F.col("v"))
    now = materialize(plain.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    state = _state(now)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        now = materialize(small.where(F.col("u") != F.col("v")).distinct(), "stars")
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components not found in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
