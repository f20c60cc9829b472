"""Shuffling, sharding, batching and mixing of training rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rookery.functions.hashing import stable_uniform


def shuffle_rows(df: DataFrame, key: str, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """df with shuffle_key, in an order drawn by key and seed, sorted within ranges: a global shuffle that any rerun repeats."""
    drawn = df.withColumn("shuffle_key", stable_uniform(key, f"shuffle{seed}"))
    ranged = drawn.repartitionByRange(partitions, "shuffle_key", key) if partitions else drawn.repartitionByRange("shuffle_key", key)
    return ranged.sortWithinPartitions("shuffle_key", key)


def assign_shard(df: DataFrame, world_size: int, chunk: str = "chunk_no") -> DataFrame:
    """df with shard: chunk modulo world size."""
    return df.withColumn("shard", (F.col(chunk) % world_size).cast("int"))


def global_index(df: DataFrame, order: list[str | Column], buckets: Column, name: str = "row_index") -> DataFrame:
    """df with a gapless index from 0 in the given order. `buckets` cuts that order into runs, one task each: the counts of
    the runs, one row each, give offsets, so no task sees all rows. buckets must not fall as the order rises."""
    rows = df.withColumn("__bucket", buckets)
    counts = rows.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("__bucket", F.coalesce(before, F.lit(0)).alias("__first"))
    inside = F.row_number().over(W.partitionBy("__bucket").orderBy(*order)) - 1
    return rows.withColumn("__k", inside).join(offsets, "__bucket").withColumn(name, F.col("__first") + F.col("__k")).drop("__bucket", "__k", "__first")


#: Rows that a task numbers, or that go to one file, are meant to be about this many.
TASK_ROWS = 1_000_000


def assign_batches(df: DataFrame, key: str, batch_size: int, seed: int = 0, runs: int | None = None) -> DataFrame:
    """df with batch_id: consecutive rows of the shuffled order, batch_size each, the last one short. The order is cut into runs,
    by default as many as keep one at about TASK_ROWS: that takes a count of df."""
    runs = runs or max(1, -(-df.count() // TASK_ROWS))
    drawn = df.withColumn("__u", stable_uniform(key, f"shuffle{seed}"))
    indexed = global_index(drawn, ["__u", key], F.floor(F.col("__u") * runs).cast("int"))
    return indexed.withColumn("batch_id", F.floor(F.col("row_index") / batch_size).cast("bigint")).drop("__u", "row_index")


def batches_per_epoch(size: int, batch_size: int, world_size: int = 1) -> int:
    return max(1, size // (batch_size * world_size))


def mix_sources(chunks: DataFrame, key: str, weight: str, seed: int = 0) -> DataFrame:
    """chunks with draw_key: ascending, they come as if drawn without replacement with probability by weight."""
    u = F.greatest(stable_uniform(key, f"mix{seed}"), F.lit(2.0**-33))
    return chunks.withColumn("draw_key", -F.log(u) / F.col(weight))


def repeat_epochs(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n passes over df, each with its own epoch and shuffle_key; passes are made by exploding each row, without a join."""
    rows = df.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n > 0 else df.limit(0).withColumn("pass", F.lit(0))
    return rows.withColumn("shuffle_key", stable_uniform(key, F.concat(F.lit(f"shuffle{seed}:"), F.col("pass").cast("string"))))


def concat_sources(dfs: list[DataFrame]) -> DataFrame:
    """Bag union by column names; columns missing from a source are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def train_validation(train: DataFrame, validation: DataFrame | None, key: str, batch_size: int, validation_batch: int, validation_size: int) -> tuple[DataFrame, DataFrame | None]:
    """Batched training and validation rows: validation from its own files, else from the training ones under another seed; none if its size is 0 or less."""
    rows = assign_batches(train, key, batch_size)
    if validation_size <= 0:
        return rows, None
    source = assign_batches(validation if validation is not None else train, key, validation_batch, seed=1)
    return rows, source.where(F.col("batch_id") < batches_per_epoch(validation_size, validation_batch))


def write_training_shards(df: DataFrame, path: str, order: list[str], shard: str = "shard", file_rows: int = TASK_ROWS) -> DataFrame:
    """df in a folder per shard, whose files, read by name, have its rows in `order` (shuffle_rows: shuffle_key and the key), at most
    file_rows each; and the manifest, which is written beside them and returned: (shard, file, n_rows, first_row), first_row
    counting the shard's rows before the file.

    Rows are dealt into ranges of (shard, order), so a shard of any size is many tasks; within a shard, ranges and their files
    follow each other in the names that Spark gives them. The order must tell rows apart for reruns to agree."""
    ranges = max(1, -(-df.count() // file_rows))
    ordered = df.repartitionByRange(ranges, shard, *order).sortWithinPartitions(shard, *order)
    ordered.write.partitionBy(shard).option("maxRecordsPerFile", file_rows).parquet(path)
    files = df.sparkSession.read.parquet(path).groupBy(shard, F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n_rows"))
    before = F.sum("n_rows").over(W.partitionBy(shard).orderBy("file").rowsBetween(W.unboundedPreceding, -1))
    files.withColumn("first_row", F.coalesce(before, F.lit(0))).write.parquet(f"{path}/{MANIFEST}")
    return df.sparkSession.read.parquet(f"{path}/{MANIFEST}")


#: The manifest's folder, which readers of the rows pass over.
MANIFEST = "_manifest"


def read_shard(spark: SparkSession, path: str, shard: int, from_row: int = 0, name: str = "shard") -> DataFrame:
    """(row_no, file, ...) of a shard from its from_row-th row on, to go on where a trainer has stopped: the manifest tells which files
    hold these rows, and only they are read. row_no is the row's place in the shard's order."""
    files = spark.read.parquet(f"{path}/{MANIFEST}").where((F.col(name) == shard) & (F.col("first_row") + F.col("n_rows") > from_row)).orderBy("file").collect()
    if not files:
        return spark.read.parquet(path).limit(0).select(F.lit(0).cast("long").alias("row_no"), "*")
    rows = spark.read.option("basePath", path).parquet(*[f"{path}/{name}={shard}/{f.file}" for f in files])
    firsts = F.broadcast(spark.createDataFrame([(f.file, f.first_row) for f in files], "__file string, __first long"))  # the list the driver reads by
    placed = rows.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__at")).join(firsts, "__file")
    return placed.select((F.col("__first") + F.col("__at")).alias("row_no"), *rows.columns).where(F.col("row_no") >= from_row)
