"""Islands of overlapping intervals, computed without putting one key's rows into one task.

Two intervals interact only if a chain of overlaps connects them, so greedy matching may run per
island.  The running maximum that finds the islands is taken in two levels: inside buckets of the
start position, and over one summary row per bucket.  A key that holds a third of all rows is thus
spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_islands(
    df: DataFrame, keys: list[str], start: str, end: str, width: float, name: str, flags: dict[str, Column] | None = None
) -> DataFrame:
    """Add the start of the island each interval belongs to.

    ``flags`` adds boolean columns that tell whether any row of the same key fulfils a condition;
    they ride on the bucket summaries.

    Islands are first found inside each bucket.  Of the islands of earlier buckets only the last one
    can reach into a bucket, so a bucket needs two values from before it: how far that island
    reaches and where it starts.
    """
    inside = Window.partitionBy(*keys, "_bucket").orderBy(start, end)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(end).over(earlier)
    opens = F.when(reach.isNull() | (F.col(start) >= reach), F.col(start))
    local = (
        df.withColumn("_bucket", F.floor(F.col(start) / width))
        .withColumn("_opens", opens)
        .withColumn("_local", F.max("_opens").over(upto))
    )
    order = Window.partitionBy(*keys).orderBy("_bucket")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    flags = flags or {}
    whole = Window.partitionBy(*keys)
    buckets = (
        local.groupBy(*keys, "_bucket")
        .agg(
            F.max(end).alias("_top"),
            F.max("_local").alias("_last"),
            *[F.max(condition).alias(f"_flag_{n}") for n, condition in flags.items()],
        )
        .withColumn("_reach", F.max("_top").over(before))
        .withColumn("_own", F.when(F.col("_reach").isNull() | (F.col("_last") >= F.col("_reach")), F.col("_last")))
        .withColumn("_open", F.max("_own").over(before))
        .select(*keys, "_bucket", "_reach", "_open", *[F.max(f"_flag_{n}").over(whole).alias(n) for n in flags])
    )
    joined = local.join(buckets, [*keys, "_bucket"])
    merged = F.col("_reach").isNotNull() & (F.col("_local") < F.col("_reach"))
    return joined.withColumn(name, F.when(merged, F.col("_open")).otherwise(F.col("_local"))).drop(
        "_bucket", "_opens", "_local", "_reach", "_open"
    )
