"""Reading the tables of a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamizal.session import standing

#: Keys that stand several times and are broadcast at most.
BROADCAST_KEYS = 1_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table by name; columns and filters are pushed into the Parquet scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, where its files make fewer.

    Costly work on each row would else run on a few cores. Larger inputs have more
    partitions than that and stay as they are, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores // 2 else df


def vacantes(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The distinct segments: rows that stand twice in all columns count once, told apart by their key."""
    wanted = ["id", *(c for c in (columns or ("text",)) if c != "id")]
    return once(table(spark, folder, "vacantes").select(*wanted), "id")


def once(df: DataFrame, key: str, name: str = "all") -> DataFrame:
    """One row for each key, of a table read from files. The keys are counted first; only rows whose key stands several times move. name: tells selections of rows from the same files apart."""
    (repeated,) = standing(df.select(F.col(key).alias("key_")), f"repeated_{key}_{name}", lambda keys: (keys.groupBy("key_").count().where("count > 1").select("key_"),))
    if repeated.count() > BROADCAST_KEYS:
        return df.dropDuplicates([key])
    same = F.col(key).eqNullSafe(F.col("key_"))
    several = df.join(F.broadcast(repeated), same, "left_semi").dropDuplicates([key])
    return df.join(F.broadcast(repeated), same, "left_anti").unionByName(several)


def lines(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """The lines of a text column, numbered from 1, blank ones included; null texts have none."""
    cut: Column = F.posexplode(F.split(text, "\n", -1))
    return df.where(F.col(text).isNotNull()).select(*keys, cut.alias("at", "line")).select(*keys, (F.col("at") + 1).alias("line_no"), "line")
