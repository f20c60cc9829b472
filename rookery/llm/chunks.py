"""Documents dealt into chunks of bounded size, with texts compressed on the way."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.llm.near_dup import texts
from rookery.llm.storage import cut, join_dictionary

SCHEMA = "chunk int, doc_ids array<long>, sizes binary, body binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per chunk that a batch has documents of: their ids, and their texts end to end, compressed."""
    for batch in (b.slice(lo, 4096) for b in batches for lo in range(0, b.num_rows, 4096)):
        chunk = np.asarray(batch.column("chunk"), np.int64)
        order = np.argsort(chunk, kind="stable")
        ids, bodies = batch.column("doc_id").to_pylist(), texts(batch.column("text"))
        edges = np.flatnonzero(np.diff(chunk[order], prepend=-1, append=-1)) if len(order) else []
        rows = [order[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)] if len(order) else []
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([int(chunk[r[0]]) for r in rows], pa.int32()), pa.array([[ids[i] for i in r] for r in rows], pa.list_(pa.int64())),
                pa.array([np.array([len(bodies[i]) for i in r], "<u4").tobytes() for r in rows], pa.binary()),
                pa.array([zlib.compress(b"".join(bodies[i] for i in r), 1) for r in rows], pa.binary()),
            ],
            ["chunk", "doc_ids", "sizes", "body"],
        )


#: Chunks that a task of a shuffle by chunk is meant to take, one after the other.
TASK_CHUNKS = 4


def tasks_for(chunks: int) -> int:
    """Partitions of a shuffle by chunk: their number follows the data."""
    return max(8, -(-chunks // TASK_CHUNKS))


#: Equal rows that stand in one chunk; more are dealt over further chunks.
EQUAL_ROWS = 64


def chunked(docs: DataFrame, chunk_bytes: int, least: int = 16) -> tuple[DataFrame, int]:
    """(docs as packed rows, shuffled by chunk; number of chunks). There are as many chunks as keep one at about chunk_bytes of
    text, `least` at least. A row's chunk is drawn by its doc_id and its text, so it doesn't depend on how the table is
    partitioned, and rows of one doc_id, of none, or copies of a text under many ids don't gather. Rows that are equal in both are
    the same wherever they go: beyond EQUAL_ROWS of them they are dealt over further chunks, numbered behind the others. A
    task that runs again deals alike. Null texts are empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", F.xxhash64("doc_id", "text"))
    equal = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size")), "equal")
    chunks = max(least, -(-int(equal.agg(F.sum("size")).first()[0] or 0) // chunk_bytes))
    many = equal.where(F.col("n") > EQUAL_ROWS).select("key", F.ceil(F.col("n") / EQUAL_ROWS).alias("salts"))
    rows = join_dictionary(rows, many, "key") if many.count() else rows.withColumn("salts", F.lit(1))
    salt = F.pmod(F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id()), F.coalesce("salts", F.lit(1)))
    dealt = rows.select("doc_id", "text", (F.pmod("key", F.lit(chunks)) + chunks * salt).cast("int").alias("chunk"))
    return dealt.mapInArrow(_pack, SCHEMA).repartition(tasks_for(chunks), "chunk"), chunks


def unpacked(table: pa.Table) -> tuple[list[int | None], list[bytes]]:
    """doc_ids and texts of a chunk, by doc_id, null last, then by text: an order that doesn't depend on how rows arrive."""
    ids, bodies = [], []
    for own, sizes, body in zip(table.column("doc_ids").to_pylist(), table.column("sizes").to_pylist(), table.column("body").to_pylist(), strict=True):
        text, at = zlib.decompress(body), 0
        for i, n in zip(own, np.frombuffer(sizes, "<u4").tolist(), strict=True):
            ids.append(i)
            bodies.append(text[at : at + n])
            at += n
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, bodies[k]))
    return [ids[k] for k in order], [bodies[k] for k in order]
