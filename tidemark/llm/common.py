"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace of the word pattern ``[^\x20\x09-\x0D]+``; ``bytes.split()`` splits on the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; a temporary one where a local session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables of one computation, deleted by ``drop`` once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Cuts the lineage: writes ``df`` as Parquet in the shared folder and reads it again.

        A lost executor costs no more than rereading the table, and Spark knows its size for join planning.
        """
        path = f"{shared_dir(self.spark)}/tidemark/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, but: int = 0) -> None:
        """Deletes the tables, but for the last ``but``."""
        gone, self.paths = self.paths[: len(self.paths) - but], self.paths[len(self.paths) - but :]
        for path in gone:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """A table that stays, see ``Scratch.keep``."""
    return Scratch(df.sparkSession).keep(df, name)


def salted_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner", salts: int = 8) -> DataFrame:
    """Joins ``small`` (one row per key) to ``big``, whose keys may be hot: each key is dealt over ``salts`` tasks."""
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right, [key, "_salt"], how).drop("_salt")
