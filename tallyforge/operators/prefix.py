"""Running sums and maxima over all rows in two levels, so that no task sees everything.

Rows are dealt by ranges of their order; each range is summed up, the ranges' totals (one row a shuffle partition) are run over in
one place, and every row adds what its own range holds before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.session import ensure_checkpoint_dir


def running(rows: DataFrame, order: list[str], value: str, out: str, how: str = "sum", inclusive: bool = False) -> DataFrame:
    """rows with ``out``: the sum or max of ``value`` over all rows before (and at, if inclusive) each in the order.

    Sums begin at 0 and maxima at null; null values count for nothing. Rows that tie in the order are taken in any
    sequence; they lie in one range. The dealt rows are cut with checkpoint(), as a range's bounds come from a sample and have
    to be the same wherever they are read.
    """
    if how not in ("sum", "max"):
        raise ValueError("sum or max")
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    fold = F.sum if how == "sum" else F.max
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(width, *order).withColumn("_range", F.spark_partition_id()).checkpoint()
    totals = dealt.groupBy("_range").agg(fold(value).alias("_total"))
    before = totals.select("_range", fold("_total").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    inside = fold(value).over(W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1))
    joined = dealt.withColumn("_inside", inside).join(F.broadcast(before), "_range")  # one row a partition
    both = F.coalesce("_before", F.lit(0)) + F.coalesce("_inside", F.lit(0)) if how == "sum" else F.greatest("_before", "_inside")
    return joined.select(*rows.columns, both.alias(out))
