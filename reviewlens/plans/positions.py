"""Row positions and running totals without a single-task window.

``row_number()`` over a whole table, or over a group that holds a third of it, sorts all those rows
in one task. Here the rows are range-partitioned by the sort key, each partition is numbered on its
own, and the partition totals (one row per partition and group) give the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from reviewlens.plans.sizing import join_lookup_null_safe, materialise

_PART = "__part"


def with_running_total(
    df: DataFrame,
    order_by: Sequence[Column],
    name: str,
    group_by: Sequence[str] = (),
    weight: Column | None = None,
) -> DataFrame:
    """Add the total of ``weight`` (1 by default) over the rows up to and including this one.

    With the default weight that is the 1-based position. ``order_by`` must be a total order.
    """
    group = list(group_by)
    weighted = df.withColumn("__weight", F.lit(1) if weight is None else weight)
    keys = [F.col(c).asc() for c in group] + list(order_by)
    # Range bounds come from a sample, so both readers below must see one and the same cut.
    cut = materialise(weighted.repartitionByRange(*keys).withColumn(_PART, F.spark_partition_id()))

    totals = cut.groupBy(_PART, *group).agg(F.sum("__weight").cast("long").alias("__total"))
    # One row per partition and group: the number of groups plus the number of partitions at most.
    before = W.partitionBy(*group).orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(_PART, *group, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"))

    inside = W.partitionBy(_PART, *group).orderBy(*order_by).rowsBetween(W.unboundedPreceding, 0)
    local = cut.withColumn(name, F.sum("__weight").over(inside).cast("long"))
    joined = join_lookup_null_safe(local, offsets, [_PART, *group], "inner", derived=True)
    return joined.withColumn(name, F.col(name) + F.col("__offset")).drop(_PART, "__offset", "__weight")


def with_position(
    df: DataFrame, order_by: Sequence[Column], name: str = "pos", group_by: Sequence[str] = ()
) -> DataFrame:
    """Add the 0-based row position over ``order_by``, within ``group_by`` if given."""
    return with_running_total(df, order_by, name, group_by).withColumn(name, F.col(name) - 1)
