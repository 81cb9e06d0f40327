"""Places of rows within their group by a global order, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch


def ranked(rows: DataFrame, scratch: Scratch, name: str, group: str, *order: str) -> DataFrame:
    """``rows`` with pos (from 0, by ``order`` within the group) and n, the size of the group.

    Rows are dealt out by ranges of (group, order), so that a group of any size is split over many tasks; only counts of
    (group, task) are added up.  The sorted table is written first: its places are fixed whatever is recomputed later.
    Groups must not be null; among rows alike in ``order`` places are arbitrary.
    """
    by = [group, *order]
    numbered = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    numbered = scratch.keep(numbered, f"{name}-sorted").withColumn("_part", F.shiftright("_at", 33))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        numbered.groupBy(group, "_part")
        .agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
        .select(
            group,
            "_part",
            (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
            F.sum("_rows").over(whole).alias("n"),
        )
    )
    # Written, so that its size is known when the join is planned
    parts = scratch.keep(parts, f"{name}-parts")
    return (
        numbered.join(parts, [group, "_part"])
        .withColumn("pos", F.col("_at") + F.col("_shift"))
        .drop("_at", "_part", "_shift")
    )
