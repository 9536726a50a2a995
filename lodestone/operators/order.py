"""Places of rows in a sorted table, without gathering the table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.storage import materialize


def with_rank(df: DataFrame, by: list[Column | str], out: str = "rank") -> DataFrame:
    """Adds ``out``: the place of each row in the order ``by``, from 0.

    The table is sorted by ranges and written; a row's place is the number of rows
    in the ranges before its own (one row a range) and its place inside. Rows that
    ``by`` doesn't tell apart stand in any order; an empty table stays empty.
    """
    sorted_ = materialize(df.sort(*by).withColumn("_range", F.spark_partition_id()), "ranked")
    sizes = sorted_.groupBy("_range").agg(F.count("*").alias("_c"))
    before = sizes.select("_range", (F.sum("_c").over(Window.orderBy("_range")) - F.col("_c")).alias("_before"))  # one row a range
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*by))
    ranked = sorted_.join(F.broadcast(before), "_range").withColumn(out, (F.col("_before") + inside - 1).cast("long"))
    return ranked.drop("_range", "_before")
