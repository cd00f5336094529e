"""Dense numbers for the values of a column, given out without the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wherewords.session import stage

_PLACE = (1 << 33) - 1


def dense_ids(df: DataFrame, col: str, out: str = "id", ranges: int | None = None) -> DataFrame:
    """(col, out): the distinct values of a column numbered 0..n-1 in their order.

    The sorted values are cut into ranges, a task each; a value's number is its place in
    the range after the sizes of the ranges before. Only those sizes, a row per range, are
    ever added up in one place. Nulls get no number. There are as many ranges as shuffle
    partitions if not told otherwise; ``df`` is read twice, as the ranges are cut by a sample.
    """
    values = df.select(col).filter(F.col(col).isNotNull()).distinct()
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The identifier counts the rows of a task in its lower 33 bits.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))
    ranged = stage(
        values.repartitionByRange(ranges, col).sortWithinPartitions(col).select(
            col, F.spark_partition_id().alias("_range"), place.alias("_place")
        ),
        "ranges",
    )
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = sizes.select("_range", (F.sum("_rows").over(Window.orderBy("_range")) - F.col("_rows")).alias("_before"))
    return ranged.join(before, "_range").select(col, (F.col("_before") + F.col("_place")).alias(out))
