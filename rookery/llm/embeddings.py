"""Near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rookery.llm.components import connected_components
from rookery.llm.storage import cut, join_dictionary


#: Rows of an order in a range, of which a task takes one.
RANGE_ROWS = 200_000
FOUND = "a long, b long, links long"


def unit_vector(v: list[float | None] | None) -> tuple[np.ndarray | None, bytes | None]:
    """(v of length 1, v's bytes), or nulls for a vector that links with nothing. It is scaled by its largest component first,
    so that squares of very large or small ones neither overflow nor vanish."""
    a = np.asarray([np.nan] if not v or any(x is None for x in v) else v, np.float64)
    most = np.abs(a).max()
    if not np.isfinite(most) or most == 0:
        return None, None
    scaled = a / most
    return scaled / np.sqrt(scaled @ scaled), a.tobytes()


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, v, copy): v of unit length in double precision, copy its bytes."""
    for batch in batches:
        both = [unit_vector(v) for v in batch.column("v").to_pylist()]
        cols = [batch.column("id").cast(pa.int64()), pa.array([x[0] for x in both], pa.list_(pa.float64())), pa.array([x[1] for x in both], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["id", "v", "copy"])


def _signed(passes: int, bits: int, seed: int):
    """(id, v, n, dim, keys): keys has one number of `bits` signs of random projections for each pass; one product per batch and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.int64)[::-1]
        for batch in batches:
            dim = np.asarray(batch.column("dim"), np.int64)
            flat, end = np.asarray(batch.column("v").flatten(), np.float64), np.cumsum(dim)
            keys = np.zeros((len(dim), passes), np.int64)
            for d in np.unique(dim).tolist():
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((d, passes * bits))
                at = np.flatnonzero(dim == d)
                v = flat[(end[at] - d)[:, None] + np.arange(d)]
                keys[at] = (v @ planes[d] >= 0).reshape(len(at), passes, bits) @ weights
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(dim) + 1) * passes, pa.int32()), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["id", "v", "n", "dim", "keys"])

    return run


def plan_passes(n: int, threshold: float, bits: int, window: int, miss: float) -> tuple[int, int]:
    """(passes, leading signs of a run) for n vectors. Runs of equal leading signs are as long as a window on average; a pair at the
    threshold shares a sign with probability 1 - angle / pi, so it shares a run in no pass with probability `miss` at most."""
    run = min(bits, max(0, math.ceil(math.log2(max(n, 1) / window))))
    p = min(max(1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi, 1e-3), 0.999) ** run
    return (1 if run == 0 else max(1, math.ceil(math.log(miss) / math.log1p(-p)))), run


class Vectors:
    """Rows of one task: vectors with their places in the orders of all passes, and the long runs they are in, -1 for none."""

    def __init__(self, part: pa.Table, passes: int, window: int):
        self.window = window
        matrix = lambda c, kind: np.asarray(part.column(c).combine_chunks().flatten(), kind).reshape(part.num_rows, -1)
        self.v = matrix("v", np.float64)
        self.ids, self.copies = np.asarray(part.column("id"), np.int64), np.asarray(part.column("n"), np.float64)
        self.places, self.runs = matrix("places", np.int64)[:, :passes], matrix("runs", np.int64)[:, :passes]
        self.n_links, self.label = np.zeros(len(self.ids)), np.arange(len(self.ids))
        self.edges: list[tuple[int, int]] = []

    def settled(self, x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
        """Whether a pass before the k-th brings each pair together, in a window or a long run."""
        out = np.zeros(np.broadcast_shapes(x.shape, y.shape), bool)
        for q in range(k):
            out |= np.abs(self.places[x, q] - self.places[y, q]) <= self.window
            out |= (self.runs[x, q] == self.runs[y, q]) & (self.runs[x, q] >= 0)
        return out

    def link(self, ok: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        """Count the links of a tile, rows x and columns y, and keep those that join parts of this task's vectors not joined before."""
        self.n_links[x] += ok @ self.copies[y]
        self.n_links[y] += self.copies[x] @ ok
        while True:
            apart = ok & (self.label[x][:, None] != self.label[y][None, :])
            rows = np.flatnonzero(apart.any(axis=1))
            if not len(rows):
                return
            for a, b in zip(x[rows].tolist(), y[apart[rows].argmax(axis=1)].tolist(), strict=True):
                if self.label[a] != self.label[b]:
                    self.label[self.label == self.label[b]] = self.label[a]
                    self.edges.append((int(self.ids[a]), int(self.ids[b])))

    def told(self) -> pa.Table:
        """(id, null, links) and, for the components, (a, b, 0)."""
        seen = np.flatnonzero(self.n_links)
        return pa.table({
            "a": pa.array([*self.ids[seen].tolist(), *(e[0] for e in self.edges)], pa.int64()),
            "b": pa.array([None] * len(seen) + [e[1] for e in self.edges], pa.int64()),
            "links": pa.array([*self.n_links[seen].astype(np.int64).tolist(), *([0] * len(self.edges))], pa.int64()),
        })


def _windows(threshold: float, passes: int, window: int, tile: int = 256):
    """A stretch of one order of one pass, with the first rows of the stretch behind it: each vector of the stretch against the
    `window` vectors after it. Pairs that an earlier pass settles are left to it, pairs of one long run to its blocks."""

    def run(part: pa.Table) -> pa.Table:
        k = part.column("pass")[0].as_py()
        part = part.take(pc.sort_indices(part.column("place")))
        rows = Vectors(part, passes, window)
        place, own = np.asarray(part.column("place"), np.int64), np.asarray(part.column("own"), bool)
        for lo in range(0, int(own.sum()), tile):
            x = np.arange(lo, min(lo + tile, int(own.sum())))
            y = np.arange(lo, np.searchsorted(place, place[x[-1]] + window, side="right"))
            gap = place[y][None, :] - place[x][:, None]
            ok = (rows.v[x] @ rows.v[y].T >= threshold) & (gap > 0) & (gap <= window)
            if ok.any():
                ok &= ~((rows.runs[x, k][:, None] == rows.runs[y, k][None, :]) & (rows.runs[x, k] >= 0)[:, None])
                a, b = np.nonzero(ok)
                ok[a, b] = ~rows.settled(x[a], y[b], k)
                rows.link(ok, x, y)
        return rows.told()

    return run


def _blocks(threshold: float, passes: int, window: int, tile: int = 512):
    """Two blocks of one long run of one pass, or one block with itself: every pair is compared. Tiles that a long run of an earlier
    pass settles whole are passed over."""

    def run(part: pa.Table) -> pa.Table:
        k, lo, hi = (part.column(c)[0].as_py() for c in ("pass", "lo", "hi"))
        rows = Vectors(part, passes, window)
        order = np.lexsort(rows.runs[:, :k].T[::-1]) if k else np.arange(part.num_rows)
        block = np.asarray(part.column("block"), np.int64)[order]

        def tiles(at: np.ndarray) -> list[tuple]:
            out = []
            for i in range(0, len(at), tile):
                t = order[at[i : i + tile]]
                first, last = rows.runs[t, :k].min(axis=0), rows.runs[t, :k].max(axis=0)
                out.append((t, np.where(first == last, first, -1)))
            return out

        left = tiles(np.flatnonzero(block == lo))
        right = left if lo == hi else tiles(np.flatnonzero(block == hi))
        for i, (x, one) in enumerate(left):
            for j in range(i if lo == hi else 0, len(right)):
                y, other = right[j]
                if ((one == other) & (one >= 0)).any():
                    continue
                ok = rows.v[x] @ rows.v[y].T >= threshold
                if lo == hi and i == j:
                    ok = np.triu(ok, 1)
                if ok.any():
                    ok &= ~rows.settled(x[:, None], y[None, :], k)
                    rows.link(ok, x, y)
        return rows.told()

    return run


def sorted_passes(signed: DataFrame, bits: int, run_bits: int, window: int, stretch: int) -> DataFrame:
    """signed (id, v, n, dim, keys) with, by pass, `places`: where a vector stands when all are sorted by length, pass and concatenated
    signs; `runs`: its leading run_bits signs if more than window + 1 vectors share them, else -1; and `blocks` of that run, else 1.

    All passes are sorted in one go, ids and keys alone: dealt into ranges, numbered inside, and offset by the ranges' counts."""
    keys = signed.select("id", "dim", F.posexplode("keys").alias("pass", "key"))
    order = ("dim", "pass", "key", "id")
    ranges = max(8, -(-keys.count() // RANGE_ROWS))
    dealt = cut(keys.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()), "orders")
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n_part"))
    before = F.coalesce(F.sum("n_part").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = cut(counts.select("part", before.alias("before")), "offsets")
    place = F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1
    rows = join_dictionary(dealt.withColumn("k", place), offsets, "part").withColumn("place", (F.col("before") + F.col("k")).cast("long"))
    rows = rows.withColumn("run", F.shiftright("key", bits - run_bits)).withColumn("cell", F.struct("pass", "dim", "run"))
    large = dealt.groupBy("pass", "dim", F.shiftright("key", bits - run_bits).alias("run")).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > window + 1)
    # a pair of blocks of 64 components or less holds up to 2 * stretch vectors, of longer ones fewer
    blocks = F.ceil(F.col("size") * F.greatest("dim", F.lit(64)) / (64 * stretch))
    large = cut(large.select(F.struct("pass", "dim", "run").alias("cell"), blocks.cast("int").alias("blocks")), "runs")
    rows = join_dictionary(rows, large, "cell")
    told = F.struct("pass", "place", F.when(F.col("blocks").isNull(), F.lit(-1).cast("long")).otherwise(F.col("run")).alias("run"), F.coalesce("blocks", F.lit(1)).alias("blocks"))
    by_id = rows.groupBy("id").agg(F.sort_array(F.collect_list(told)).alias("p"))
    return cut(signed.drop("keys").join(by_id.select("id", F.col("p.place").alias("places"), F.col("p.run").alias("runs"), F.col("p.blocks").alias("blocks")), "id"), "places")


def near_duplicate_vectors(
    vectors: DataFrame, threshold: float = 0.95, bits: int = 48, window: int = 512, stretch: int = 4096, seed: int = 3,
    id_col: str = "vec_id", vector_col: str = "embedding", miss: float = 1e-6,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row.

    Equal vectors form a class that goes on as its smallest id; its members are linked with each other. In each pass the
    classes are sorted lexicographically by the concatenated signs of `bits` random projections, and each is compared, in double
    precision, with the `window` classes after it; pairs with cosine >= threshold are links. Links of all passes are united. The
    number of passes follows from the counted classes (plan_passes). Where a window doesn't reach the end of the run of equal
    leading signs, as in a large group of near copies, the run is settled exactly: it is dealt into blocks by hash, and each
    task compares one pair of blocks of a bounded number of components. So a pair at the threshold is missed with probability `miss`
    at most, at any size and however vectors crowd. A pair is counted in the first pass that brings it together, which its places in
    all orders tell. n_links counts vectors, copies included. component_id is the smallest id reachable by links.

    Null, empty and zero vectors, and those with null or non-finite components, link with nothing: n_links 0, component
    their own id. Vectors of different lengths are compared among their own length only. Different vectors under one
    id count as one, the smallest by bytes. A null id has the component of its class, if that has another id.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    units = cut(rows.mapInArrow(_units, "id long, v array<double>, copy binary"), "units")
    groups = units.where("copy IS NOT NULL").groupBy("copy").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("rep IS NOT NULL")
    groups = cut(groups, "groups")
    main = groups.groupBy(F.col("rep").alias("id")).agg(F.min("copy").alias("copy"), F.min_by("n", "copy").alias("n"))
    reps = units.join(main, ["copy", "id"]).dropDuplicates(["id"])
    reps = cut(reps.select("id", "v", "n", F.size("v").alias("dim")), "reps")
    most = reps.groupBy("dim").count().agg(F.max("count")).first()[0] or 0
    passes, run_bits = plan_passes(most, threshold, bits, window, miss)
    stretch = max(stretch, window)
    signed = cut(reps.mapInArrow(_signed(passes, bits, seed), "id long, v array<double>, n long, dim int, keys array<long>"), "signed")
    placed = sorted_passes(signed, bits, run_bits, window, stretch)
    each = placed.select("id", "v", "n", "dim", "places", "runs", F.posexplode(F.arrays_zip("places", "runs", "blocks")).alias("pass", "at"))
    each = each.withColumn("place", F.col("at.places"))
    here = F.floor(F.col("place") / stretch)
    near = F.when(F.col("place") % stretch < window, F.array(here, here - 1)).otherwise(F.array(here))
    windows = each.withColumn("into", F.explode(near)).withColumn("own", F.col("into") == here)
    windows = windows.select("id", "v", "n", "places", "runs", "pass", "dim", "place", "into", "own")
    found = windows.groupBy("pass", "dim", "into").applyInArrow(_windows(threshold, passes, window), FOUND)
    crowded = each.where("at.runs >= 0").withColumn("blocks", F.col("at.blocks")).withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("blocks")))
    crowded = crowded.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
    crowded = crowded.select("id", "v", "n", "places", "runs", "pass", "dim", F.col("at.runs").alias("run"), "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    found = cut(found.union(crowded.groupBy("pass", "dim", "run", "lo", "hi").applyInArrow(_blocks(threshold, passes, window), FOUND)), "found")
    links = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    comps = connected_components(found.where("b IS NOT NULL"), "a", "b").withColumnRenamed("node", "rep")
    told = groups.join(links, "rep", "left").join(comps, "rep", "left")
    told = told.select("copy", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = units.select("id", "copy").join(told, "copy", "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
