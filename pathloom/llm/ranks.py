"""Places of rows in an order, without any one task seeing a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, small_side

#: Above so many pairs of a partition and a group, they are joined by a shuffle.
FEW = 1_000_000


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with group_no (from 0, nulls first), pos (from 0 within its group) and width (rows of the group).

    rows should be settled, since dealing by ranges reads them twice. They are dealt by ranges of
    (group, order) and sorted there, so a group with a third of all rows lies in a third of the
    partitions; what a task adds to its rows' places comes from counts by (partition, group), of
    which there are fewer than partitions and groups together. Rows that repeat group and order are
    told apart by where they lay, so that they don't gather either.
    """
    whole = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(group, *order, "_tie").sortWithinPartitions(group, *order, "_tie")
    dealt = settled(whole.drop("_tie").withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    runs = dealt.groupBy("_part", F.col(group).alias("_g")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    of_group = Window.partitionBy("_g")
    runs = runs.withColumns({"_before": F.sum("_n").over(of_group.orderBy("_part")) - F.col("_n"), "width": F.sum("_n").over(of_group)})
    runs = settled(runs.withColumn("_opens", (F.col("_before") == 0).cast("long")))
    # one row a partition that has rows, so this order is a small one
    opened = runs.groupBy("_part").agg(F.sum("_opens").alias("_opened"))
    opened = opened.select(F.col("_part").alias("_p"), (F.sum("_opened").over(Window.orderBy("_part")) - F.col("_opened")).alias("_groups"))
    runs = runs.join(F.broadcast(opened), F.col("_part") == F.col("_p")).drop("_p")
    group_no = F.col("_groups") + F.sum("_opens").over(Window.partitionBy("_part").orderBy(F.col("_g").asc_nulls_first())) - 1
    runs = small_side(runs.select(F.col("_part").alias("_p"), "_g", "_first", "_before", "width", group_no.alias("group_no")), FEW)
    at = dealt.join(runs, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return at.withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_p", "_g", "_first", "_before")
