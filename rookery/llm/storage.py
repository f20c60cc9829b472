"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join may be broadcast if it has at most this many rows ...
BROADCAST_ROWS = 20_000
#: ... else the large side is spread over this many salts per key.
SALTS = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where none is named, a session on one machine gets a temporary one, and any
    other an error: executors elsewhere couldn't read it."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    set_before = sc._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get()
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="rookery-")
    sc.setCheckpointDir(own)
    return own


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/rookery/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df written as Parquet in the shared folder and read back: later steps start from files
    that survive lost executors, and Spark knows their size."""
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table made by cut() that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def join_dictionary(big: DataFrame, small: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join a table of one row per key (made by cut(), so counting is cheap) to a skewed big one.

    Up to BROADCAST_ROWS rows it is broadcast. Beyond, each of its rows is repeated for SALTS salts and
    big's rows are dealt over the salts, so that no key meets in one task. Null keys match each other.
    """
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small.withColumnRenamed(key, "__key")), F.col(key).eqNullSafe(F.col("__key")), how).drop("__key")
    spread = small.withColumnRenamed(key, "__key").withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = big.withColumn("__salt", F.pmod(F.xxhash64(*big.columns), F.lit(SALTS)).cast("int"))
    on = F.col(key).eqNullSafe(F.col("__key")) & (F.col("__salt") == F.col("__s"))
    return salted.join(spread, on, how).drop("__key", "__s", "__salt")


def uniform(*key: Column | int | str) -> Column:
    """A repeatable draw from [0, 1) by key."""
    cols = [k if isinstance(k, Column) else F.lit(k) for k in key]
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, inside higher-order functions."""
    return F.transform(F.array(value), body)[0]
