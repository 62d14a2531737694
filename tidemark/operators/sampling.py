"""Seeded draws and samples of exact size, repeatable from keys alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _digest(*parts) -> Column:
    """A whole number below 2^52 from the parts' MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("long")


def draw_ranks(groups: DataFrame, draws: int, n: int, seed: int) -> DataFrame:
    """(t, draw, ord, rank): for each draw, n of the ranks 0 to m - 1 of each group (t, m), without replacement; all of them if m is n or less.

    Robert Floyd's method: step i of n takes a random number up to m - n + i, or that limit itself if the number
    is already taken. So every set is equally likely, and the work is draws times n, whatever m is.
    """
    each = groups.filter("m > 0").select("t", "m", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    size = F.least(F.lit(n), F.col("m"))

    def step(taken: Column, i: Column) -> Column:
        last = (F.col("m") - size + i).cast("long")
        r = F.pmod(_digest(F.lit(seed), F.col("draw"), F.col("t"), i), last + 1)
        return F.concat(taken, F.array(F.when(F.array_contains(taken, r), last).otherwise(r)))

    picks = F.aggregate(F.sequence(F.lit(0), (size - 1).cast("int")), F.array().cast("array<bigint>"), step)
    return each.select("t", "draw", F.posexplode(picks).alias("ord", "rank")).select("t", "draw", (F.col("ord") + 1).alias("ord"), "rank")


def sample_rows(df: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """Exactly n rows, or all if there are fewer: those of the smallest digest of seed and ``key``, which tells rows apart.

    Each task keeps its n smallest and the smallest of all are merged, so no more than n rows of a task move.
    """
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in key]).cast("binary"))
    return df.orderBy(digest, *key).limit(n)
