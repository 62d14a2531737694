"""Exact medians of large groups: a sketch brackets the middle, and the values inside the bracket are counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The sketch's ranks are wrong by one part in so many at most; the bracket is twice as wide to either side.
ACCURACY = 1000


def medians(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, medians, counts): arrays with the exact median and the number of values of each of ``columns``, by group.

    No task gets a whole group. Sketches of bounded size, merged from all tasks, give a bracket that holds the
    middle; a second pass counts what is below it and each distinct value inside, a few thousandths of a
    group. The brackets are broadcast, a row for each group and column: groups are few (sessions), rows are
    not. A group without values has a null median.
    """
    margin = 2 / ACCURACY
    sketched = df.groupBy(*keys).agg(
        F.array(*[F.struct(F.percentile_approx(c, [0.5 - margin, 0.5 + margin], ACCURACY).alias("b"), F.count(c).alias("n")) for c in columns]).alias("s")
    )
    marks = sketched.select(*keys, F.posexplode("s").alias("i", "s")).select(*keys, "i", F.col("s.b")[0].alias("lo"), F.col("s.b")[1].alias("hi"), F.col("s.n").alias("n"))
    cells = df.select(*keys, F.posexplode(F.array(*columns)).alias("i", "x")).filter("x IS NOT NULL").join(F.broadcast(marks), [*keys, "i"])
    inside = cells.filter("x <= hi").groupBy(*keys, "i", "n", F.when(F.col("x") >= F.col("lo"), F.col("x")).alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(W.partitionBy(*keys, "i").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("v")))
    found = inside.withColumn("upto", upto).groupBy(*keys, "i", "n").agg(((at(low) + at(high)) / 2).alias("m"), F.sum(F.when(F.col("v").isNull(), F.col("c"))).alias("below"))
    # the sketch's guarantee, checked: the lower middle isn't below the bracket, the upper one isn't above
    sure = (F.coalesce("below", F.lit(0)) < low) & F.col("m").isNotNull()
    exact = found.select(*keys, "i", "n", F.when(sure, F.col("m")).otherwise(F.raise_error(F.lit("the bracket missed the median")).cast("double")).alias("m"))
    pick = lambda k, c: F.max(F.when(F.col("i") == k, F.col(c)))
    return exact.groupBy(*keys).agg(
        F.array(*[pick(k, "m") for k in range(len(columns))]).alias("medians"), F.array(*[F.coalesce(pick(k, "n"), F.lit(0)) for k in range(len(columns))]).alias("counts")
    )
