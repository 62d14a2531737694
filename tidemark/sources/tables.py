"""Panels over the given tables: suppliers are tickers, ship months are sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.panel import dense


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def monthly_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return line.groupBy(F.trunc("l_shipdate", "MM").alias("date"), F.col("l_suppkey").alias("ticker")).agg(F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity")).alias("close_adj"), F.avg(unit).alias("close_raw"))


def monthly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, date, ticker, close_adj, close_raw, open_adj, open_raw), dense; a session opens at the last close."""
    w = W.partitionBy("ticker").orderBy("t")
    grid = dense(monthly_cells(spark, sf_dir))
    return grid.withColumns({"open_adj": F.lag("close_adj").over(w), "open_raw": F.lag("close_raw").over(w)})


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, name, sector): the region of each supplier."""
    t = lambda n: table(spark, sf_dir, n)
    home = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return home.select(F.col("s_suppkey").alias("ticker"), F.col("s_name").alias("name"), F.col("r_name").alias("sector"))


def spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, name, sector, start_date, end_date): a membership spell per supplier and return flag, from first to last ship day; flag N is open."""
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("ticker"), "l_returnflag").agg(F.to_date(F.min("l_shipdate")).alias("start_date"), F.to_date(F.max("l_shipdate")).alias("last"))
    end = F.when(F.col("l_returnflag") != "N", F.col("last"))
    return line.join(sectors(spark, sf_dir), "ticker").select(F.concat(F.lit(" s"), "ticker").alias("code"), "ticker", F.concat_ws(" ", "name", F.when(F.col("l_returnflag") == "A", "old")).alias("name"), "sector", "start_date", end.alias("end_date"))


def ship_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
