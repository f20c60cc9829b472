"""Zero blocks of activations and the neuron order that makes more of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.functions.folders import shared_folder

BLOCK = 4
#: Samples whose bitmaps are one row: n / 8 bytes for each.
CHUNK = 8192


def zero_block_rate(acts: DataFrame, block: int = BLOCK, sample: str = "sample_id", neuron: str = "neuron", zero: str = "is_zero") -> DataFrame:
    """One row (rate): share of (sample, block of neurons) that are all zero."""
    blocks = acts.groupBy(sample, F.floor(F.col(neuron) / block).alias("block")).agg(F.bool_and(zero).alias("z"))
    return blocks.agg(F.avg(F.col("z").cast("double")).alias("rate"))


def packed_activations(acts: DataFrame, n: int, sample: str = "sample_id", neuron: str = "neuron", zero: str = "is_zero", chunk: int = CHUNK) -> DataFrame:
    """(chunk, bits): for about `chunk` samples, n bitmaps of the samples at which a neuron is zero, end to end, as little-endian 64-bit
    words. Written as a table, so that later steps neither shuffle nor regroup activations. Neurons that a sample doesn't list, and
    nulls, aren't zero; neurons beyond n are an error."""
    chunks = max(1, -(-acts.count() // (n * chunk)))
    rows = acts.select(F.col(sample).cast("long").alias("sample"), F.col(neuron).cast("int").alias("neuron"), F.col(zero).alias("zero"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("sample"), F.lit(chunks)).cast("int"))

    def pack(part: pa.Table) -> pa.Table:
        samples, at = np.unique(np.asarray(part.column("sample")), return_inverse=True)
        places = np.asarray(part.column("neuron"), np.int64)
        if len(places) and places.max() >= n:
            raise ValueError(f"neuron {places.max()} in a layer of {n}")
        z = np.zeros((n, -(-len(samples) // 64) * 64), bool)
        z[places, at] = np.asarray(part.column("zero").fill_null(False).combine_chunks(), bool)
        bits = np.packbits(z, axis=1, bitorder="little").tobytes()
        return pa.table({"chunk": part.column("chunk").slice(0, 1), "bits": pa.array([bits], pa.binary())})

    packed = rows.repartition(max(8, chunks), "chunk").groupBy("chunk").applyInArrow(pack, "chunk int, bits binary")
    path = shared_folder(acts.sparkSession, "activations")
    packed.write.parquet(path)
    return acts.sparkSession.read.schema(packed.schema).parquet(path)


def zero_counts(bits: np.ndarray, block: int) -> np.ndarray:
    """g[i, j]: samples at which neuron i is zero and so are all others of j's block; bits is neurons x words."""
    n = len(bits)
    inside = bits.reshape(-1, block, bits.shape[1])
    g = np.zeros((n, n), np.int64)
    for j in range(n):
        others = np.bitwise_and.reduce(np.delete(inside[j // block], j % block, axis=0), axis=0)
        g[:, j] = np.bitwise_count(bits & others).sum(axis=1, dtype=np.int64)
    return g


def _counts(packed: DataFrame, order: list[int], block: int) -> DataFrame:
    """(i, js): row i of the matrix of zero_counts over all samples, with neuron order[p] in place p. A task reads its bitmaps in that
    order and sends one matrix, so only n * n numbers a task are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for body in batch.column("bits"):
                part = zero_counts(np.frombuffer(body.as_buffer(), "<u8").reshape(len(order), -1)[order], block)
                total = part if total is None else total + part
        if total is not None:
            n = len(total)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * n, pa.int32()), pa.array(total.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n), pa.int32()), rows], ["i", "js"])

    def add(part: pa.Table) -> pa.Table:
        rows = np.asarray(part.column("js").combine_chunks().flatten()).reshape(part.num_rows, -1).sum(axis=0)
        return pa.table({"i": part.column("i").slice(0, 1), "js": pa.array([rows], pa.list_(pa.int64()))})

    return packed.select("bits").mapInArrow(run, "i int, js array<bigint>").groupBy("i").applyInArrow(add, "i int, js array<bigint>")


def swap_gain_matrix(acts: DataFrame, block: int = BLOCK, sample: str = "sample_id", neuron: str = "neuron", zero: str = "is_zero") -> DataFrame:
    """(i, j, gain): how many zero blocks are gained in j's block if i's values stood in j's place; 0 within a block.

    g0[i, j] counts samples where i is zero and so are all others of j's block; gain is g0[i, j] - g0[j, j]. Counts are of ANDed
    bitmaps (packed_activations); each task sends the matrix of its samples once.
    """
    n = -(-((acts.agg(F.max(neuron)).first()[0] or 0) + 1) // block) * block
    rows = _counts(packed_activations(acts, n, sample, neuron, zero), list(range(n)), block)
    counts = rows.select("i", F.posexplode("js").alias("j", "g"))
    own = counts.where("i = j").select("j", F.col("g").alias("own"))
    gain = F.when(F.floor(F.col("i") / block) == F.floor(F.col("j") / block), 0).otherwise(F.col("g") - F.col("own"))
    return counts.join(own, "j").select("i", "j", gain.cast("bigint").alias("gain"))


def best_swaps(gains: DataFrame, block: int = BLOCK) -> DataFrame:
    """(i, j, gain) with i < j in different blocks: what a swap of the two gains in both blocks."""
    back = gains.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("gain").alias("back"))
    both = gains.join(back, ["i", "j"]).where(F.col("i") < F.col("j"))
    return both.where(F.floor(F.col("i") / block) != F.floor(F.col("j") / block)).select("i", "j", (F.col("gain") + F.col("back")).alias("gain"))


def apply_permutation(df: DataFrame, perm: list[int], neuron: str = "neuron") -> DataFrame:
    """df renumbered: place p gets what neuron perm[p % n] was, in each run of n = len(perm) neurons; numbers are looked up in a literal array."""
    n = len(perm)
    place = [0] * n
    for p, old in enumerate(perm):
        place[old] = p
    new = F.get(F.array(*map(F.lit, place)), (F.col(neuron) % n).cast("int"))
    return df.withColumn(neuron, (F.col(neuron) - F.col(neuron) % n + new).cast(dict(df.dtypes)[neuron]))


def _disjoint(gain: np.ndarray, moves: np.ndarray, block: int) -> list[tuple[int, ...]]:
    """Moves (rows of neurons) in order of falling gain, ties by their neurons, that share no block with one taken before."""
    out, used = [], set()
    for m in moves[np.lexsort((*moves.T[::-1], -gain))].tolist():
        blocks = {x // block for x in m}
        if not blocks & used:
            out.append(tuple(m))
            used |= blocks
    return out


def _swaps(g: np.ndarray, block: int) -> list[tuple[int, ...]]:
    """Disjoint swaps of positive gain, largest first."""
    of = np.arange(len(g)) // block
    two = np.triu(np.where(of[:, None] != of[None, :], g + g.T, 0), 1)
    swaps = np.argwhere(two > 0)
    return _disjoint(two[swaps[:, 0], swaps[:, 1]], swaps, block) if len(swaps) else []


def _rotations(g: np.ndarray, block: int) -> list[tuple[int, ...]]:
    """Disjoint rotations i to j to k to i over three blocks, largest gain first. Of the rotations over the same three blocks only
    the best is kept, so there are at most (n / block) ** 3 / 3 of them."""
    n = len(g)
    blocks = n // block
    gains, found = [], []
    for first in range(blocks):
        own = np.arange(first * block, (first + 1) * block)
        rest = np.arange((first + 1) * block, n)  # a rotation is named from its lowest block on
        if len(rest) < 2 * block:
            break
        # i goes to j's place, j to k's and k to i's; axes: i, block and place of j, block and place of k
        three = g[own][:, rest][:, :, None] + g[rest][:, rest][None] + g[rest][:, own].T[:, None, :]
        m = len(rest) // block
        three = three.reshape(block, m, block, m, block).transpose(1, 3, 0, 2, 4).reshape(m, m, -1)
        at, top = three.argmax(axis=2), three.max(axis=2)
        np.fill_diagonal(top, 0)
        for a, b in np.argwhere(top > 0).tolist():
            i, j, k = np.unravel_index(at[a, b], (block,) * 3)
            gains.append(top[a, b])
            found.append((own[i], rest[a * block + j], rest[b * block + k]))
    return _disjoint(np.array(gains), np.array(found), block) if found else []


def best_swap(gains: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row (i, j, gain): the swap that gains most, the first by its neurons among equals; none if no swap gains."""
    swaps = best_swaps(gains, block).where("gain > 0")
    best = swaps.agg(F.max_by(F.struct("i", "j", "gain"), F.struct("gain", -F.col("i"), -F.col("j"))).alias("b"))
    return best.where("b IS NOT NULL").select("b.*")


def permutation_rounds(acts: DataFrame, n: int, block: int = BLOCK, rounds: int = 50) -> Iterator[list[int]]:
    """The order after each round that gains: perm[p] is the neuron that goes to place p. Rounds of swaps until none gains, then rounds
    of rotations until none does, `rounds` rounds in all.

    Activations are shuffled once, into bitmaps of samples per neuron; a round reads them in the order reached. What comes to
    the driver is the n by n matrix of a layer, whatever the number of samples.
    """
    packed = packed_activations(acts, n)
    perm, stages = list(range(n)), [_swaps, _rotations]
    for _ in range(rounds):
        g = np.zeros((n, n), np.int64)
        for r in _counts(packed, perm, block).toArrow().to_batches():
            g[np.asarray(r.column("i"))] = np.asarray(r.column("js").flatten()).reshape(-1, n)
        of = np.arange(n) // block
        g = np.where(of[:, None] == of[None, :], 0, g - np.diag(g))
        moves = stages[0](g, block)
        if not moves:
            if len(stages) == 1:
                return
            stages.pop(0)
            continue
        for m in moves:
            old = [perm[x] for x in m]
            for where, who in zip(m, [old[-1], *old[:-1]] if len(m) > 2 else old[::-1], strict=True):
                perm[where] = who
        yield list(perm)


def find_permutation(acts: DataFrame, n: int, block: int = BLOCK, rounds: int = 50) -> list[int]:
    """perm with perm[p] the neuron that goes to place p, after the last of permutation_rounds."""
    perm = list(range(n))
    for perm in permutation_rounds(acts, n, block, rounds):
        pass
    return perm


def collect_activations(halves: DataFrame) -> DataFrame:
    """(sample_id, neuron, is_zero) from pairwise activations (row_id, perspective, values): each perspective of a position is a sample."""
    rows = halves.select((F.col("row_id") * 2 + F.col("perspective")).alias("sample_id"), F.posexplode("values").alias("neuron", "value"))
    return rows.select("sample_id", "neuron", (F.col("value") <= 0).alias("is_zero"))
