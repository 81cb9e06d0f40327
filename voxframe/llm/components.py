"""Connected components by alternating stars, without collecting a node's neighbours anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v): larger neighbours (large) or the others (small) go to the least of u's neighbourhood."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = both.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    return (
        joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionAll(least.select("u", F.col("m").alias("v")))
        .where("u <> v")
        .distinct()
    )


def connected(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component): for every node of ``edges`` (u, v) that is not its component's least, that least node.

    Each step's edges are written; the steps end when they no longer change, which takes a number of steps that grows
    with the logarithm of the components' size.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = scratch.keep(edges.where("u <> v").select("u", "v").distinct(), f"{name}-0")
    last, step = state(now), 0
    while last[0]:
        step += 1
        now = scratch.keep(_star(_star(now, True), False), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        this = state(now)
        if this == last:
            break
        last = this
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
