"""Row numbers and running sums over one global order, without a window over a single partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.sources.store import materialised


def _ranges(df: DataFrame, *order: str) -> DataFrame:
    """``df`` sorted by range and written, with its partition as ``__p``: written, as sampling bounds again might move rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialised(df.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()), "ranges")


def running_sum(df: DataFrame, value: str, *order: str, name: str = "upto") -> DataFrame:
    """Adds the sum of ``value`` over all rows up to each, in the order of columns that no two rows share: within ranges of
    that order, plus what the ranges before hold. Only one row for each range meets in a single place."""
    s = _ranges(df, *order)
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sums = s.groupBy("__p").agg(F.sum(value).alias("__s")).select("__p", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__before"))
    here = F.sum(value).over(Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return s.withColumn("__here", here).join(F.broadcast(sums), "__p").withColumn(name, F.col("__before") + F.col("__here")).drop("__p", "__here", "__before")


def numbered(df: DataFrame, *order: str, name: str = "rn") -> DataFrame:
    """Adds numbers from 1 in the order of columns that no two rows share."""
    return running_sum(df.withColumn("__one", F.lit(1).cast("bigint")), "__one", *order, name=name).drop("__one")
