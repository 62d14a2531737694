"""Files of the engine: long panels and tables in Parquet, CSV inputs, JSON manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PANELS = ("close_adj", "open_adj", "open_raw", "membership", "rs_score", "rs_slope")
TABLES = ("meta", "risk_free")


def save_table(df: DataFrame, folder: str, name: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}.parquet")


def save_panel(panel: DataFrame, folder: str, name: str) -> None:
    """A long panel (date, ticker, value); doubles are stored as floats."""
    save_table(panel.select(*[F.col(c).cast("float").alias(c) if k == "double" else F.col(c) for c, k in panel.dtypes]), folder, name)


def load_panel(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A long panel in the order of its dates and tickers, floats as doubles."""
    panel = load_table(spark, folder, name)
    return panel.select(*[F.col(c).cast("double").alias(c) if k == "float" else F.col(c) for c, k in panel.dtypes]).orderBy("date", "ticker")


def store_panel(panel: DataFrame, name: str, buckets: int, path: str | None = None) -> None:
    """A panel as a table of the catalogue, bucketed by ticker and sorted by session.

    A window over a ticker's sessions, a join of panels by ticker or an aggregate by it then needs no exchange.
    The panel is dealt by ticker first, so that each bucket is one file.
    """
    writer = panel.repartition(buckets, "ticker").write.mode("overwrite").format("parquet").option("compression", "zstd").bucketBy(buckets, "ticker").sortBy("ticker", "t")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def stored_panel(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def save_dataset(spark: SparkSession, folder: str, panels: dict[str, DataFrame], meta: DataFrame, risk_free: DataFrame, manifest: dict) -> None:
    """All panels and tables of a study, and the manifest, which goes last: a folder without one is incomplete."""
    for name in PANELS:
        save_panel(panels[name], folder, name)
    save_table(meta.select("ticker", "name", "sector"), folder, "meta")
    save_table(risk_free.select("date", "rf"), folder, "risk_free")
    save_manifest(spark, folder, manifest)


def load_dataset(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], dict]:
    """The panels and tables by name, and the manifest; raises if any is missing."""
    if lost := missing(spark, folder):
        raise FileNotFoundError(f"{folder} lacks {lost}")
    return {n: load_panel(spark, folder, n) for n in PANELS} | {n: load_table(spark, folder, n) for n in TABLES}, load_manifest(spark, folder)


def is_demo(manifest: dict) -> bool:
    """The flag demo_data; as a text, empty, false, 0 and no mean no."""
    flag = manifest.get("demo_data", False)
    return flag.strip().lower() not in ("", "false", "0", "no") if isinstance(flag, str) else bool(flag)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load_wide_panel(spark: SparkSession, path: str, value: str, date: str = "date") -> DataFrame:
    """A wide file (one column per ticker) as (date, ticker, value), by date and ticker; NaN means missing and becomes null."""
    wide = spark.read.parquet(path)
    tickers = [c for c in wide.columns if c != date]
    long = wide.unpivot([date], [F.col(f"`{c}`").cast("double").alias(c) for c in tickers], "ticker", value)
    return long.select(F.to_date(date).alias("date"), "ticker", F.nanvl(value, F.lit(None).cast("double")).alias(value)).orderBy("date", "ticker")


def missing(spark: SparkSession, folder: str, names: tuple[str, ...] = PANELS + TABLES) -> list[str]:
    return [n for n in names if not _exists(spark, f"{folder}/{n}.parquet")]


def save_manifest(spark: SparkSession, folder: str, manifest: dict) -> None:
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")


def load_manifest(spark: SparkSession, folder: str) -> dict:
    if not _exists(spark, f"{folder}/manifest"):
        return {}
    return json.loads(spark.read.text(f"{folder}/manifest").first()[0])


EXCLUSIONS = "ord long, ticker string, start_date date, end_date date, reason string"


def load_exclusions(spark: SparkSession, path: str | None) -> DataFrame:
    """(ord, ticker, start_date, end_date, reason) of a CSV with # comments, in its order.

    Unreadable dates are null, both null meaning the whole series; rows without a ticker are left out. A file
    that isn't there means none, and so does NONE, as the path or as a ticker.
    """
    if path is None or path.strip().upper() == "NONE" or not _exists(spark, path):
        return spark.createDataFrame([], EXCLUSIONS)
    raw = spark.read.csv(path, header=True, comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    need = {"ticker", "start_date", "end_date", "reason"}
    if lost := need - set(raw.columns):
        raise ValueError(f"exclusions lack {sorted(lost)}")
    day = lambda c: F.expr(f"try_to_date({c})").alias(c)
    clean = raw.select(F.monotonically_increasing_id().alias("ord"), F.upper(F.trim("ticker")).alias("ticker"), day("start_date"), day("end_date"), F.coalesce(F.nullif(F.trim("reason"), F.lit("")), F.lit("unspecified")).alias("reason")).filter("ticker <> ''")
    off = clean.groupBy().agg(F.coalesce(F.bool_or(F.col("ticker") == "NONE"), F.lit(False)).alias("off"))
    return clean.join(F.broadcast(off)).filter("NOT off").drop("off")  # one row


def exclusions_manifest(spark: SparkSession, path: str | None) -> dict:
    """What was really read: the file, whether it is there, its rows and tickers, and twelve digits of its SHA-256."""
    none = {"file": path, "exists": False, "disabled": path is not None and path.strip().upper() == "NONE", "rows": 0, "tickers": [], "fingerprint": None}
    if path is None or none["disabled"] or not _exists(spark, path):
        return none
    digest = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
    found = load_exclusions(spark, path).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("ticker")).alias("tickers")).first()
    return none | {"exists": True, "rows": found["n"], "tickers": found["tickers"], "fingerprint": digest[:12]}


def save_proposals(proposals: DataFrame, path: str) -> None:
    """Proposed exclusions as CSV, ready to be read as exclusions."""
    proposals.select("ticker", "start_date", "end_date", "reason").orderBy("ticker").coalesce(1).write.mode("overwrite").csv(path, header=True)


def _columns(df: DataFrame, names: dict[str, str], what: str) -> DataFrame:
    if lost := set(names) - set(df.columns):
        raise ValueError(f"{what} lacks {sorted(lost)}")
    return df.select(*[F.col(f"`{k}`").alias(v) for k, v in names.items()])


def read_spells(spark: SparkSession, path: str) -> DataFrame:
    """(code, start_date, end_date) of a CSV of membership spells; rows without a code or a start are left out."""
    raw = _columns(spark.read.csv(path, header=True), {"ticker": "code", "start_date": "start_date", "end_date": "end_date"}, "the list of spells")
    return raw.select("code", *[F.expr(f"try_to_date({c})").alias(c) for c in ("start_date", "end_date")]).filter("code IS NOT NULL AND start_date IS NOT NULL")


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """(ord, code, name, sector, industry) of the CSV of current members, in its order."""
    raw = _columns(spark.read.csv(path, header=True), {"Symbol": "code", "Security": "name", "GICS Sector": "sector", "GICS Sub-Industry": "industry"}, "the current list")
    return raw.withColumns({"code": F.upper(F.trim("code")), "ord": F.monotonically_increasing_id()}).select("ord", "code", "name", "sector", "industry")


def load_constituents(spells: DataFrame, current: DataFrame) -> DataFrame:
    """Spells with the name and sector of the current list (``ord`` gives its order), of whose repeated codes the last row counts; open spells are active."""
    listed = current.withColumn("code", F.upper(F.trim("code"))).groupBy("code").agg(F.max_by(F.struct("name", "sector"), "ord").alias("now"))
    own = lambda c: F.coalesce(F.col(c), F.col(f"now.{c}")) if c in spells.columns else F.col(f"now.{c}")
    joined = spells.withColumn("code", F.upper(F.trim("code"))).join(listed, "code", "left")
    return joined.select("code", own("name").alias("name"), own("sector").alias("sector"), "start_date", "end_date", F.col("end_date").isNull().alias("is_active_now"))


def daily_risk_free(yields: DataFrame) -> DataFrame:
    """(date, rf) of annual percentages ``yields`` (date, y)."""
    return yields.select("date", (F.pow(1 + F.col("y") / 100, F.lit(1 / 252)) - 1).alias("rf"))


def first_risk_free(spark: SparkSession, sources: list[tuple[str, DataFrame | None]], start: str, end: str) -> tuple[str, DataFrame]:
    """(name, (date, rf)) of the first source of yields that has any row; a constant rate, named so, for want of one."""
    for name, yields in sources:
        if yields is not None and not yields.isEmpty():
            return name, daily_risk_free(yields)
    return "constant 2%", constant_risk_free(spark, start, end)


def constant_risk_free(spark: SparkSession, start: str, end: str, annual_pct: float = 2.0) -> DataFrame:
    """(date, rf) on business days, for want of a quoted yield."""
    days = spark.sql(f"SELECT explode(sequence(date'{start}', date'{end}')) AS date").filter("weekday(date) < 5")
    return days.withColumn("rf", F.lit((1 + annual_pct / 100) ** (1 / 252) - 1))
