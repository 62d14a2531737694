"""Running products and maxima of long series, block by block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Periods of a block.
BLOCK = 4096


def running_growth(df: DataFrame, factor: Column, keys: list[str], order: str, block: Column, growth: str, peak: str | None = None) -> DataFrame:
    """Adds the product of ``factor`` up to each row of its series, and the largest product so far as ``peak``.

    ``block`` numbers stretches of a series in its order. Each stretch is a task's own: products inside it, then
    a pass over the stretches, of which there are few, gives what precedes each. So one endless series is
    spread like many short ones. Rows without a factor leave the product as it is.
    """
    by = [*keys, "_block"]
    inside = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    local = df.withColumn("_block", block).withColumn("_factor", factor).withColumn("_local", F.coalesce(F.product("_factor").over(inside), F.lit(1.0)))
    local = local.withColumn("_top", F.max("_local").over(inside))
    blocks = local.groupBy(*by).agg(F.max_by("_local", order).alias("_total"), F.max("_local").alias("_most"))
    blocks = blocks.withColumn("_start", F.coalesce(F.product("_total").over(before), F.lit(1.0)))
    blocks = blocks.withColumn("_peak", F.max(F.col("_start") * F.col("_most")).over(before)).select(*by, "_start", "_peak")
    out = local.join(blocks, by).withColumn(growth, F.col("_start") * F.col("_local"))
    if peak:
        out = out.withColumn(peak, F.greatest("_peak", F.col("_start") * F.col("_top")))
    return out.select(*df.columns, growth, *[peak] * bool(peak))
