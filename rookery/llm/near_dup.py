"""Near-duplicate documents: fast similarity sketches, banding, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.llm.components import connected_components
from rookery.llm.sketch import Sketcher
from rookery.llm.storage import cut
from rookery.llm.words import WordHashes, shingle_set

#: Buckets of more members are compared in blocks of as many, inside tasks.
BLOCK = 256
#: Columns of the 0/1 matrix with which a task counts common shingles.
SLICE = 4096


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, null as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def small(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in slices, so that only so many texts stand in memory as Python objects at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def _sketches(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sketcher = WordHashes(), Sketcher(bands, rows)
        for batch in small(batches):
            n, fp, keys = [], [], []
            for text in texts(batch.column("text")):
                s = shingle_set(hashes.of(text.lower().split()), words)
                n.append(len(s))
                fp.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(sketcher.band_keys(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("hash"), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "hash", "n", "fp", "keys"],
            )

    return run


def _sets(words: int):
    """(id, s) of the rows whose text has the class's fingerprint: rows of other texts under the same doc_id fall out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in small(batches):
            sets = [shingle_set(hashes.of(t.lower().split()), words) for t in texts(batch.column("text"))]
            own = [xxhash.xxh3_128_digest(s.tobytes()) == fp for s, fp in zip(sets, batch.column("fp").to_pylist(), strict=True)]
            kept = [s.view(np.int64) for s, o in zip(sets, own, strict=True) if o]
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(own, pa.bool_())), pa.array(kept, pa.list_(pa.int64()))], ["id", "s"])

    return run


def _star(percent: int):
    """Links of one block of a hub's members: the hub's set is there once."""

    def run(block: pa.Table) -> pa.Table:
        ids, hub = block.column("id").to_pylist(), block.column("a")[0].as_py()
        sets = {i: np.asarray(s.values, np.int64) for i, s in zip(ids, block.column("s"), strict=True)}
        own = sets.get(hub)
        found = []
        for i, s in sets.items():
            if own is not None and i != hub:
                both = len(np.intersect1d(own, s, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(s) - both):
                    found.append(i)
        return pa.table({"a": pa.array([hub] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    return run


def verified_stars(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of hubs and members whose whole sets are similar enough. A hub's members are dealt into blocks of about
    BLOCK, and the hub's set goes to each block once, so a hub of very many members meets in no one task."""
    blocks = stars.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = stars.join(blocks, "a").select("a", F.pmod(F.xxhash64("b"), "blocks").cast("int").alias("block"), F.col("b").alias("id"))
    hubs = blocks.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("a").alias("id"))
    filled = dealt.unionByName(hubs).join(sets, "id")
    return filled.groupBy("a", "block").applyInArrow(_star(percent), "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    left, right = (sets.select(F.col("id").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
    n = lambda c: F.size(c).cast("long")
    full = pairs.join(left, "a").join(right, "b").withColumn("both", n(F.array_intersect("sa", "sb")))
    return full.where(100 * F.col("both") >= percent * (n("sa") + n("sb") - F.col("both"))).select("a", "b")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of intersection sizes, by slices of the shingles that two sets or more hold."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, where, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    new = np.cumsum(times > 1) - 1
    shared = times[where] > 1
    col, owner = new[where[shared]], owner[shared]
    order = np.argsort(col, kind="stable")
    col, owner = col[order], owner[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for lo in range(0, int(new[-1]) + 1, SLICE):
        i, j = np.searchsorted(col, [lo, lo + SLICE])
        m = np.zeros((len(sets), SLICE), np.float32)
        m[owner[i:j], col[i:j] - lo] = 1
        out += m @ m.T
    return out.astype(np.int64)


def _cell(percent: int):
    """Links between members of different components in one pair of blocks; each component needs one link to another."""

    def run(cell: pa.Table) -> pa.Table:
        ids, comp = cell.column("id").to_pylist(), cell.column("comp").to_pylist()
        sets = [np.asarray(s.values, np.int64) for s in cell.column("s")]
        both = common_counts(sets)
        n = np.array([len(s) for s in sets])
        number = {c: i for i, c in enumerate(dict.fromkeys(comp))}
        code = np.array([number[c] for c in comp])
        ok = (100 * both >= percent * (n[:, None] + n[None, :] - both)) & (code[:, None] < code[None, :])
        x, y = np.nonzero(ok)
        first = {}
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            first.setdefault((code[i], code[j]), (ids[i], ids[j]))
        return pa.table({"a": pa.array([p[0] for p in first.values()], pa.int64()), "b": pa.array([p[1] for p in first.values()], pa.int64())})

    return run


def block_cells(large: DataFrame, size: int = BLOCK) -> DataFrame:
    """(key, i, j, id, comp) of bucket members (key, rep, comp): cells of two blocks of about `size` members in which all pairs of different
    components meet. Members of a bucket's largest component aren't compared with each other, so their blocks meet only those of the
    rest: where one component has nearly all of a bucket, as it has once its hub is verified, rows grow with the members, not with their square."""
    held = large.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    most = held.groupBy("key").agg(F.max_by("comp", F.struct("c", -F.col("comp"))).alias("top"), F.max("c").alias("n_top"), F.sum("c").alias("n"))
    most = most.select("key", "top", F.ceil(F.col("n_top") / size).cast("int").alias("tops"), F.ceil((F.col("n") - F.col("n_top")) / size).cast("int").alias("rests"))
    dealt = large.join(most, "key").withColumn("rest", F.col("comp") != F.col("top")).withColumn("hash", F.xxhash64("rep"))
    mine = F.when(F.col("rest"), F.pmod("hash", F.greatest("rests", F.lit(1)))).otherwise(F.col("rests") + F.pmod("hash", "tops")).cast("int")
    last = F.col("rests") - 1 + F.when(F.col("rest"), F.col("tops")).otherwise(0)
    cells = dealt.where("rests > 0").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return cells.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.col("rep").alias("id"), "comp")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 32, rows: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of docs (doc_id, text).

    A document's set holds the hashes of its distinct shingles of `words` words, A-Z in lower case; fewer words are one
    shingle; no words, an empty or a null text are an empty set that is linked with nothing. Documents are linked when
    the similarity of their sets is percent/100 or more. component_id is the smallest doc_id reachable over links.

    Equal sets form a class with a number of its own, whatever its doc_ids are. Classes sketched with bands * rows coordinates meet in
    buckets of equal bands; at similarity 0.8 a pair misses all of 32 bands of 4 once in 20 million. Every bucket's
    members are first verified against its most central one, the member that meets most others: near copies of one
    text hang together after that. Only buckets that still hold several components compare the rest: small ones as
    pairs, larger ones as pairs of blocks inside tasks, where members of one component aren't compared.
    No candidate is dropped.

    Rows with equal doc_ids are judged each by its own text, and may be of different components. A null doc_id links like any
    other; a component without any doc_id has a null component_id, and its rows are kept.
    """
    return grouped(docs, words, percent, bands, rows).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def grouped(docs: DataFrame, words: int, percent: int, bands: int = 32, rows: int = 4) -> DataFrame:
    """(doc_id, hash, n_shingles, group, component_id) per row of docs: hash is that of the text, group numbers the component, null
    for an empty set. See near_duplicates."""
    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    known = cut(rows_in.mapInArrow(_sketches(words, bands, rows), "doc_id long, hash long, n long, fp binary, keys array<long>"), "sketches")
    classes = known.where("fp IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("low"), F.first("keys").alias("keys"))
    classes = cut(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    banded = classes.select(F.explode("keys").alias("key"), "rep")
    sizes = banded.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = cut(banded.join(sizes, "key"), "members")
    # the most central member: it meets most others over all bands
    score = members.groupBy("rep").agg(F.sum("m").alias("score"))
    scored = members.join(score, "rep")
    hubs = scored.groupBy("key").agg(F.max_by("rep", F.struct("score", -F.col("rep"))).alias("hub"))
    stars = cut(scored.join(hubs, "key").where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    wanted = classes.join(members.select("rep").distinct(), "rep").select("low", "fp", F.col("rep").alias("id"))
    asked = rows_in.join(wanted, F.col("doc_id").eqNullSafe(F.col("low"))).select("id", "fp", "text")
    sets = asked.mapInArrow(_sets(words), "id long, s array<long>")
    repeated = known.where("fp IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sets = cut(sets if repeated.isEmpty() else sets.dropDuplicates(["id"]), "sets")
    links = cut(verified_stars(stars, sets, percent), "links")
    parts = connected_components(links, "a", "b")
    placed = members.join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).select("key", "m", "rep", "comp")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    placed = cut(placed.join(mixed, "key"), "mixed")
    small = placed.where(F.col("m") <= BLOCK // 8)
    x, y = (small.select("key", F.col("rep").alias(r), F.col("comp").alias(c)) for r, c in (("a", "ca"), ("b", "cb")))
    pairs = x.join(y, "key").where("ca <> cb AND a < b").select("a", "b").distinct()
    more = verified(pairs, sets, percent)
    large = placed.where(F.col("m") > BLOCK // 8)
    cells = block_cells(large)
    filled = cells.join(sets, "id")
    more = more.union(filled.groupBy("key", "i", "j").applyInArrow(_cell(percent), "a long, b long"))
    found = connected_components(links.union(cut(more, "more")), "a", "b")
    classes = classes.select("fp", "rep", "low").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("group", F.coalesce("component", "rep"))
    least = classes.groupBy("group").agg(F.min("low").alias("component_id"))
    named = classes.join(least, "group").select("fp", "group", "component_id")
    out = known.select("doc_id", "hash", F.col("n").alias("n_shingles"), "fp").join(named, "fp", "left")
    alone = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "hash", "n_shingles", "group", alone.alias("component_id"))


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs less all but one document of each group: that of the smallest doc_id, null last, and among rows of one doc_id that of
    the smallest hash of its text; of rows alike in both one stays. Documents without words are in no group: all stay."""
    judged = grouped(docs, words, percent).where("group IS NOT NULL")
    least = judged.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "hash")).alias("k"))
    least = cut(least.select(F.col("k.doc_id").alias("__id"), F.col("k.hash").alias("__hash")), "kept")
    filled = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    chosen = docs.where(filled).join(least, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left_semi")
    if not judged.groupBy("doc_id", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        chosen = chosen.withColumn("__hash", F.xxhash64("text")).dropDuplicates(["doc_id", "__hash"]).drop("__hash")
    return chosen.unionByName(docs.where(~filled))
