"""Joins and ranks that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlab.session import materialise

# A group with more rows than this is not sorted by one task.
HOT_ROWS = 1_000_000
# Most groups named one by one as large; beyond it all rows are ranked the way large groups are.
MAX_NAMED = 1_000


def checked_broadcast(small: DataFrame, max_rows: int) -> DataFrame | None:
    """``small`` as a broadcast local table if it proves to have ``max_rows`` rows at most, else None.

    The table is computed once: the rows that prove the bound are the ones broadcast.
    """
    rows = small.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return None
    return F.broadcast(small.sparkSession.createDataFrame(rows, small.schema))


def lookup_join(rows: DataFrame, table: DataFrame, on: Sequence[str], max_rows: int = 10_000) -> DataFrame:
    """Left join to a lookup table unique on ``on``: broadcast if proven small, else left to Spark.

    A plain join on a key with very many rows is split by adaptive execution.
    """
    small = checked_broadcast(table, max_rows)
    return rows.join(table if small is None else small, list(on), "left")


def rank_in_groups(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    out: str,
    hot_rows: int = HOT_ROWS,
    rows: int | None = None,
) -> DataFrame:
    """0-based position of each row in its group; no large group is sorted by one task alone.

    Group sizes are counted, partially before the shuffle. Groups of at most ``hot_rows`` rows use one
    window. Rows of larger ones are range-partitioned on (group, order) and written with a running row
    id; a group that spans partitions gets its offset from the row counts of the partitions before.
    That offset table has at most one row per partition plus one per group. With more than
    ``MAX_NAMED`` large groups all rows go that way. ``order`` must be unique within the group, and
    ``df`` cheap to read more than once. ``rows`` is the most rows a group can have, if known.
    """
    window = W.partitionBy(*group).orderBy(*order)
    by_window = (F.row_number().over(window) - 1).cast("long")
    if rows is not None and rows <= hot_rows:
        return df.withColumn(out, by_window)
    large = df.groupBy(*group).count().filter(F.col("count") > hot_rows).select(F.xxhash64(*group).alias("h"))
    hashes = [r["h"] for r in large.limit(MAX_NAMED + 1).collect()]
    if not hashes:
        return df.withColumn(out, by_window)
    is_hot = F.xxhash64(*group).isin(hashes) if len(hashes) <= MAX_NAMED else F.lit(True)
    plain = df.filter(~is_hot).withColumn(out, by_window)

    hot = df.filter(is_hot)
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), hot.count() // hot_rows + 1)
    sorted_rows = materialise(
        hot.repartitionByRange(parts, *group, *order)
        .sortWithinPartitions(*group, *order)
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_row", 33)),
        "ranked",
    )
    pieces = sorted_rows.groupBy(*group, "_part").agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    earlier = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = pieces.select(
        *group,
        "_part",
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    placed = (
        sorted_rows.join(offsets, [*group, "_part"])
        .withColumn(out, F.col("_row") + F.col("_shift"))
        .select(*df.columns, out)
    )
    return plain.unionByName(placed)
