"""Token-id files compressed by grammars of id pairs, with random access."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from rookery.llm.bpe import gathered, load, tokenizer_file
from rookery.llm.storage import cut, join_dictionary
from rookery.llm.words import MULT

#: Ids of about this many make a shard with a grammar of its own; a document isn't divided.
SHARD_IDS = 1 << 20
#: A rule takes 12 bytes (two symbols and its length) and each use saves 4: it pays for itself from this many uses on.
PAYS = 4


def _frequent(pair: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of entries whose pair occurs `least` times or more, that pair's number among them), pairs numbered from the most frequent on."""
    slot = ((pair * MULT) >> np.uint64(44)).astype(np.int32)  # 2**20 slots: an upper bound on each pair's count
    at = np.flatnonzero(np.bincount(slot, minlength=1 << 20)[slot] >= least) if len(pair) > 4096 else np.arange(len(pair))
    coded = pa.array(pair[at]).dictionary_encode()
    where, found = np.asarray(coded.indices), np.asarray(coded.dictionary)
    times = np.bincount(where)
    often = np.flatnonzero(times >= least)
    # equally frequent ones in scattered order: a long passage's pairs would else give way to each other one by one
    scattered = ((found[often] * MULT) >> np.uint64(44)).astype(np.int64)
    rank = np.full(len(times), -1, np.int32)
    rank[often[np.argsort(scattered - (times[often] << 20), kind="stable")]] = np.arange(len(often))
    rank = rank[where]
    kept = rank >= 0
    return at[kept], rank[kept]


def _apart(at: np.ndarray, rank: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, ranks) of pairs that may be replaced together: every second one of a run of one pair, then, where pairs
    overlap, the more frequent one. Of the pairs left, those with fewer than `least` places wait for a later round."""
    same = (np.diff(at, prepend=-2) == 1) & (np.diff(rank, prepend=-1) == 0)
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(at))))
    odd = (np.arange(len(at)) - first) % 2 == 1
    at, rank = at[~odd], rank[~odd]
    enough = np.bincount(rank)[rank] >= least
    at, rank = at[enough], rank[enough]
    if not len(at):
        return at, rank
    touch = np.diff(at) == 1
    beaten = np.zeros(len(at), bool)
    beaten[1:] |= touch & (rank[1:] > rank[:-1])
    beaten[:-1] |= touch & (rank[:-1] > rank[1:])
    at, rank = at[~beaten], rank[~beaten]
    enough = np.bincount(rank)[rank] >= least
    return at[enough], rank[enough]


def compress(ids: np.ndarray, least: int = PAYS) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(base, symbols, rules, lengths) of an array of ids.

    Nonterminals are numbered from base, one above the largest id. A round counts pairs of neighbours, gives each that
    occurs `least` times or more without overlap a nonterminal, and replaces them, the more frequent ones first where
    they overlap. Rounds go on until no pair is left that a rule would pay for: there is no other stop. Rule k is the
    pair rules[k]; it names ids and earlier nonterminals only and stands for lengths[k] ids.

    After the first round only pairs that hold a new nonterminal, or that lost a place to an overlap, can have become
    worth a rule, so later rounds look at those places alone.
    """
    base = int(ids.max()) + 1 if len(ids) else 0
    seq = ids.astype(np.uint64)
    rules, lengths = [np.zeros((0, 2), np.uint64)], np.zeros(0, np.int64)
    look = np.arange(max(0, len(seq) - 1))
    made = base
    while len(look):
        pair = (seq[look] << np.uint64(32)) | seq[look + 1]
        index, rank = _frequent(pair, least)
        candidates = look[index]
        at, rank = _apart(candidates, rank, least)
        if not len(at):
            break
        used, where = np.unique(rank, return_inverse=True)
        one = np.zeros(len(used), np.int64)
        one[where] = at
        more = np.stack([seq[one], seq[one + 1]], axis=1)
        size = lambda s: np.where(s < base, 1, lengths[np.maximum(s.astype(np.int64) - base, 0)] if len(lengths) else 1)  # noqa: B023, E731
        lengths = np.concatenate([lengths, size(more[:, 0]) + size(more[:, 1])])
        rules.append(more)
        seq[at] = (made + where).astype(np.uint64)
        made += len(used)
        stays = np.ones(len(seq), bool)
        stays[at + 1] = False
        open_again = np.zeros(len(seq), bool)
        open_again[candidates] = True  # those that lost a place, where they still stand
        open_again[at] = True
        # a pair begins at the symbol before a new one too
        before = np.maximum(np.where(stays[at - 1], at - 1, at - 2), 0)
        open_again[before] = True
        seq = seq[stays]
        look = np.flatnonzero(open_again[stays])
        look = look[look < len(seq) - 1]
    return base, seq.astype("<u4"), np.concatenate(rules).astype("<u4"), lengths.astype("<u4")


def expand(symbols: np.ndarray, base: int, rules: np.ndarray) -> np.ndarray:
    """The ids that the symbols stand for. Rules that the symbols need are written out once each, those of ids alone first,
    then those that need written ones only; the symbols' ids are then copied from there."""
    seq = symbols.astype(np.int64)
    left, right = rules[:, 0].astype(np.int64), rules[:, 1].astype(np.int64)
    need = np.zeros(len(rules), bool)
    fresh = np.unique(seq[seq >= base]) - base
    while len(fresh):
        need[fresh] = True
        parts = np.unique(np.concatenate([left[fresh], right[fresh]]))
        parts = parts[parts >= base] - base
        fresh = parts[~need[parts]]
    # slot 0 .. base-1 are ids, which stand for themselves
    used = np.unique(np.concatenate([seq[seq < base], left[need & (left < base)], right[need & (right < base)]]))
    first, n = np.zeros(base + len(rules), np.int64), np.zeros(base + len(rules), np.int64)
    first[used], n[used] = np.arange(len(used)), 1
    flat, held = [used.astype("<u4")], len(used)
    todo = np.flatnonzero(need)
    while len(todo):
        done = (n[left[todo]] > 0) & (n[right[todo]] > 0)
        now, todo = todo[done], todo[~done]
        both = np.stack([left[now], right[now]], axis=1).reshape(-1)
        store = flat[0] if len(flat) == 1 else np.concatenate(flat)
        more = gathered(store, first[both], n[both])
        n[base + now] = n[both].reshape(-1, 2).sum(axis=1)
        first[base + now] = held + np.cumsum(n[base + now]) - n[base + now]
        flat, held = [store, more], held + len(more)
    return gathered(np.concatenate(flat), first[seq], n[seq]).astype("<u4")


def expand_range(symbols: np.ndarray, base: int, rules: np.ndarray, lengths: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Ids lo to hi (exclusive) of a shard; only the symbols that cover them are expanded."""
    s = symbols.astype(np.int64)
    size = np.ones(len(s), np.int64)
    size[s >= base] = lengths[s[s >= base] - base]
    ends = np.cumsum(size)
    first, last = np.searchsorted(ends, lo, side="right"), np.searchsorted(ends, hi, side="left") + 1
    skip = int(ends[first - 1]) if first else 0
    return expand(symbols[first:last], base, rules)[lo - skip : hi - skip]


def planes(a: np.ndarray) -> bytes:
    """32-bit integers as four runs of bytes, lowest bytes first, so that file compression sees the empty high bytes together."""
    return a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplanes(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1)


FORMAT = "part int, shard int, base long, n_ids long, doc_ids array<long>, doc_sizes array<long>, symbols binary, rules binary, lengths binary"


def _shard_rows(tokenizer, end_id: int, shard_ids: int):
    def packed(part: int, shard: int, docs: list, sizes: list[int], raw: list[bytes]) -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(raw), "<u4")
        base, symbols, rules, lengths = compress(ids)
        row = {"part": part, "shard": shard, "base": base, "n_ids": len(ids), "doc_ids": docs, "doc_sizes": sizes, "symbols": planes(symbols), "rules": planes(rules.reshape(-1)), "lengths": planes(lengths)}
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], list(row))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = load(tokenizer.value), np.array([end_id], "<u4").tobytes()
        part, shard, docs, sizes, raw, held = TaskContext.get().partitionId(), 0, [], [], [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                some = batch.slice(lo, 2048)
                ids, n = encoder.documents(some.column("text"))
                ids, stop = ids.astype("<u4").tobytes(), 4 * np.cumsum(n)
                for i, a, b in zip(some.column("doc_id").to_pylist(), (stop - 4 * n).tolist(), stop.tolist(), strict=True):
                    docs.append(i)
                    sizes.append((b - a) // 4 + 1)
                    raw += (ids[a:b], end)
                    held += sizes[-1]
                    if held >= shard_ids:
                        yield packed(part, shard, docs, sizes, raw)
                        shard, docs, sizes, raw, held = shard + 1, [], [], [], 0
        if docs:
            yield packed(part, shard, docs, sizes, raw)

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, shard_ids: int = SHARD_IDS) -> None:
    """Ids of every whole text, each document's followed by end_id, written to `path` in ascending order of doc_id.

    Documents are dealt into ranges of doc_id (part) and sorted; about shard_ids ids make a shard. A shard is one row
    of the FORMAT, in Parquet files: the grammar's symbols, rules and expansion lengths, and the documents with their
    numbers of ids. (part, shard) is the order of the ids. Null doc_ids come first; rows with one doc_id stand together,
    in an order drawn from their texts, so that very many of them are dealt over several ranges. Null texts are empty: end_id alone. An empty table gives files without rows.
    """
    tokenizer = tokenizer_file(docs, tokenizer_path)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    # rows of one doc_id, equal ones too, may be dealt over several ranges, so that none grows with them
    ordered = rows.repartitionByRange(n, "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row").drop("tie", "row")
    ordered.mapInArrow(_shard_rows(tokenizer, end_id, shard_ids), FORMAT).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of the files: start counts the ids of all documents before, ids are
    little-endian unsigned 32-bit integers with the end id. Shards are offset by the totals of the parts before theirs
    and of the shards before them in their part."""
    files = spark.read.schema(FORMAT).parquet(path)
    sizes = files.select("part", "shard", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("part_start"))
    inside = F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("inside", inside).join(parts, "part")
    starts = cut(starts.select(F.struct("part", "shard").alias("cell"), (F.col("part_start") + F.col("inside")).alias("start")), "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = batch.slice(row, 1).to_pylist()[0]
                ids = expand(unplanes(r["symbols"]), r["base"], unplanes(r["rules"]).reshape(-1, 2)).tobytes()
                ends = np.cumsum(np.array(r["doc_sizes"], np.int64))
                begins = ends - r["doc_sizes"]
                own = [ids[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array(begins + r["start"], pa.int64()), pa.array(r["doc_sizes"], pa.int64()), pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array(own, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    shards = join_dictionary(files.select("base", "doc_ids", "doc_sizes", "symbols", "rules", F.struct("part", "shard").alias("cell")), starts, "cell").drop("cell")
    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def read_document(spark: SparkSession, path: str, doc_id: int | None) -> list[int] | None:
    """Ids of one document, null doc_ids included, by expanding only the symbols that cover it; None if it isn't there.
    Of rows that share a doc_id the one that stands first in the files is read."""
    held = F.exists("doc_ids", lambda i: i.eqNullSafe(F.lit(doc_id).cast("long")))
    files = spark.read.schema(FORMAT).parquet(path).where(held).orderBy("part", "shard").limit(1).collect()
    if not files:
        return None
    r = files[0]
    i = r.doc_ids.index(doc_id)
    lo = sum(r.doc_sizes[:i])
    return expand_range(unplanes(r.symbols), r.base, unplanes(r.rules).reshape(-1, 2), unplanes(r.lengths), lo, lo + r.doc_sizes[i]).tolist()
