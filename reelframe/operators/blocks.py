"""Running sums and carried values over ordered rows, by blocks.

A window ordered over all rows of a movie, or of a table without movies, is one
task. Here rows have a place (a frame, a sample, a chunk): blocks of BLOCK
places are reduced by partial aggregation, the windows over all of it run on
one row a block, and each block adds its own rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.pixels import div

BLOCK = 4096


def _window(keys: list[str], order: list[str], last: int):
    parts = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return parts.orderBy(*order).rowsBetween(Window.unboundedPreceding, last)


def running_sum(df: DataFrame, keys: list[str], at: str, value: str | Column, out: str, block: int = BLOCK) -> DataFrame:
    """df with `out`: the sum of `value` over the rows of the same keys at earlier places. Null counts as 0."""
    v = F.col(value) if isinstance(value, str) else value
    rows = df.withColumn("_v", F.coalesce(v.cast("long"), F.lit(0).cast("long"))).withColumn("_block", div(F.col(at), block))
    totals = rows.groupBy(*keys, "_block").agg(F.sum("_v").alias("_t"))
    base = F.coalesce(F.sum("_t").over(_window(keys, ["_block"], -1)), F.lit(0))
    inside = F.coalesce(F.sum("_v").over(_window([*keys, "_block"], [at], -1)), F.lit(0))
    joined = rows.withColumn("_inside", inside).join(totals.select(*keys, "_block", base.alias("_base")), [*keys, "_block"])
    return joined.select(*df.columns, (F.col("_base") + F.col("_inside")).cast("long").alias(out))


def carried(df: DataFrame, keys: list[str], at: str, value: str, out: str, tie: str | None = None, block: int = BLOCK) -> DataFrame:
    """df with `out`: the last value that isn't null at this place or an earlier one of the same keys. Of rows at
    one place those of lesser `tie` come first."""
    order = [at, tie] if tie else [at]
    rows = df.withColumn("_block", div(F.col(at), block))
    inside = F.last(value, ignorenulls=True).over(_window([*keys, "_block"], order, 0))
    place = F.when(F.col(value).isNotNull(), F.struct(*order))
    lasts = rows.groupBy(*keys, "_block").agg(F.max_by(value, place).alias("_last"))
    carry = lasts.select(*keys, "_block", F.last("_last", ignorenulls=True).over(_window(keys, ["_block"], -1)).alias("_carry"))
    return rows.withColumn("_inside", inside).join(carry, [*keys, "_block"]).select(*df.columns, F.coalesce("_inside", "_carry").alias(out))
