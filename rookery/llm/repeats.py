"""Removal of repeated passages by suffix trees over anchored suffixes, split by prefixes of variable length."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.llm.bpe import strings
from rookery.llm.chunks import chunked, tasks_for, unpacked
from rookery.llm.storage import cut
from rookery.llm.words import mix, window_hashes

#: Words of the shortest prefix.
PREFIX = 8
#: Suffixes that a tree, and so a task, is meant to hold, about 150 MB: a prefix that more suffixes share is lengthened.
GROUP = 131_072
OTHER = np.uint64(0xE7037ED1A0B428DB)

KEYS = "chunk int, key long, n long"
PACKS = "bucket int, chunk int, no binary, doc binary, first binary, ids array<long>, anchor binary, windows binary, texts binary"
WINDOWS = "k1 long, k2 long, lost boolean, doc_id long, chunk int, doc int, first int"
MARKS = "chunk int, docs array<int>, firsts array<int>, masks array<int>"


def _u4(a: np.ndarray) -> bytes:
    return a.astype("<u4").tobytes()


class Chunk:
    """The documents of one chunk by doc_id, as numbers of words.

    A window is `depth` words of one document. Its anchor is the run of PREFIX words inside it with the smallest hash, the
    leftmost of equal ones, so equal windows have equal anchors at equal places. Windows side by side mostly share their
    anchor: such a run of windows is a part, and its words are the suffix that begins at the anchor, as far as its
    windows reach, with what they need of the words before it.
    """

    def __init__(self, table: pa.Table, depth: int, hashed: bool = True):
        self.depth, self.span = depth, depth - PREFIX
        self.ids, bodies = unpacked(table)
        lists = pc.ascii_split_whitespace(pa.array(bodies, pa.large_binary()).cast(pa.large_string()))
        flat = lists.flatten()
        real = pc.greater(pc.binary_length(flat), 0)
        so_far = np.concatenate([[0], np.cumsum(np.asarray(real), dtype=np.int64)])
        self.base = so_far[np.asarray(lists.offsets, np.int64)]
        self.sizes = np.diff(self.base)
        self.words = flat.filter(real)
        if not hashed:
            return
        coded = self.words.dictionary_encode()
        names = np.fromiter(map(xxhash.xxh3_64_intdigest, strings(coded.dictionary)), np.uint64, len(coded.dictionary))
        self.h = names[np.asarray(coded.indices)]
        n = np.maximum(self.sizes - depth + 1, 0)
        doc = np.repeat(np.arange(len(n)), n)
        start = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + self.base[doc]
        grams = window_hashes(self.h, PREFIX)
        if len(start):
            near = np.lib.stride_tricks.sliding_window_view(grams, self.span + 1)
            anchor = start + near.argmin(axis=1)[start]
            new = (np.diff(anchor, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0)
            begins = np.flatnonzero(new)
            self.start, self.n = start[begins], np.diff(np.append(begins, len(start)))
            self.anchor, self.doc = anchor[begins], doc[begins]
        else:
            self.start = self.n = self.anchor = self.doc = np.zeros(0, np.int64)
        self.key = grams[self.anchor] if len(self.anchor) else np.zeros(0, np.uint64)


def _is_in(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def _told(table: pa.Table, hot: bool) -> np.ndarray:
    """Sorted keys of prefixes that have a tree, or (hot) of those that are lengthened."""
    key = np.asarray(table.column("key"), np.int64).view(np.uint64)
    return np.sort(key[np.asarray(table.column("hot"), bool) == hot])


def _keys(depth: int):
    """The chunk's distinct prefixes, with their numbers of suffixes."""

    def run(docs: pa.Table) -> pa.Table:
        found, n = np.unique(Chunk(docs, depth).key, return_counts=True)
        return pa.table({"chunk": pa.array(np.full(len(found), docs.column("chunk")[0].as_py()), pa.int32()), "key": found.view(np.int64), "n": n})

    return run


def _packs(depth: int, buckets: int):
    """The parts of the chunk that go to trees, by bucket of prefixes: equal words are sent once."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        names = ["bucket", "chunk", "no", "doc", "first", "ids", "anchor", "windows", "texts"]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        rows = []
        if docs.num_rows and told.num_rows:
            c = Chunk(docs, depth)
            mine = _is_in(c.key, _told(told, False))
            start, n, anchor, doc, key = (a[mine] for a in (c.start, c.n, c.anchor, c.doc, c.key))
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(c.words)], pa.int32()), c.words.cast(pa.string())), " ")[0].as_py().encode()
            edge = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(c.words), np.int64) + 1)])
            lo, hi = edge[start].tolist(), (edge[start + n + depth - 1] - 1).tolist()
            bucket = (mix(key) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((start, bucket))
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1)) if len(order) else []
            pack, chunk = zstandard.ZstdCompressor(level=3).compress, docs.column("chunk")[0].as_py()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own = order[a:b]
                number: dict[bytes, int] = {}
                no = np.array([number.setdefault(joined[lo[i] : hi[i]], len(number)) for i in own.tolist()])
                each = own[np.unique(no, return_index=True)[1]]
                rows.append((
                    int(bucket[own[0]]), chunk, _u4(no), _u4(doc[own]), _u4(start[own] - c.base[doc[own]]), [c.ids[d] for d in doc[own].tolist()],
                    _u4(anchor[each] - start[each]), _u4(n[each]), pack(b"\n".join(number)),
                ))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return run


def _nodes(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows of m, common length of each with the one before): a suffix array with its LCPs; -1 ends a row."""
    order = np.lexsort(m.T[::-1])
    same = (m[order][1:] == m[order][:-1]) & (m[order][1:] >= 0)
    return order, np.concatenate([[0], np.cumprod(same, axis=1).sum(axis=1)])


def _node_at(order: np.ndarray, lcp: np.ndarray, depth: int) -> np.ndarray:
    """For each row the number of the tree's node, or edge, that it passes at a depth: rows that agree so far have one number."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(lcp < depth)
    return out


def later_windows(texts: list[bytes], anchor: np.ndarray, windows: np.ndarray, depth: int) -> np.ndarray:
    """For each text, in order of first appearance, the bits of those of its windows that an earlier text has too.

    The texts' suffixes from the anchor on are sorted, and so are the words before it, read backwards. Two windows that
    begin o words before their anchors are equal if both pass the same node at depth - o words to the right and at o
    words to the left: an internal node there, `depth` words deep together, is a repeat.
    """
    coded = np.asarray(pc.split_pattern(pa.array([b" ".join(texts).decode()], pa.large_string()), " ").flatten().dictionary_encode().indices, np.int32)
    size = windows + depth - 1
    begin = np.cumsum(size) - size
    to_right = anchor[:, None] + np.arange(depth)
    to_left = anchor[:, None] - 1 - np.arange(depth - PREFIX)
    take = lambda to: np.where((to >= 0) & (to < size[:, None]), coded[np.clip(begin[:, None] + to, 0, len(coded) - 1)], np.int32(-1))
    right, left = _nodes(take(to_right)), _nodes(take(to_left))
    out = np.zeros(len(texts), np.int64)
    for o in range(depth - PREFIX + 1):
        at = anchor - o
        has = np.flatnonzero((at >= 0) & (at < windows))
        node = _node_at(*right, depth - o)[has] * (len(texts) + 1) + _node_at(*left, o)[has]
        again = np.ones(len(has), bool)
        again[np.unique(node, return_index=True)[1]] = False
        out[has[again]] |= 1 << at[has[again]]
    return out


def _trees(depth: int):
    """One group: the trees of its prefixes, and which windows of which chunk are found earlier."""

    def run(group: pa.Table) -> pa.Table:
        number: dict[bytes, int] = {}
        anchors, counts, cols = [], [], []
        unpack = zstandard.ZstdDecompressor().decompress
        for r in group.to_pylist():
            own = [number.setdefault(t, len(number)) for t in unpack(r["texts"]).split(b"\n")]
            if len(number) > len(anchors):
                new = np.array(own) >= len(anchors)
                anchors += np.frombuffer(r["anchor"], "<u4")[new].tolist()
                counts += np.frombuffer(r["windows"], "<u4")[new].tolist()
            no, doc, first = (np.frombuffer(r[c], "<u4").astype(np.int64) for c in ("no", "doc", "first"))
            lost = np.array([i is None for i in r["ids"]])
            ids = np.array([i or 0 for i in r["ids"]], np.int64)
            cols.append((np.array(own)[no], np.full(len(no), r["chunk"]), doc, first, ids, lost))
        text, chunk, doc, first, ids, lost = (np.concatenate(x) for x in zip(*cols, strict=True))
        order = np.lexsort((first, doc, chunk, ids, lost))
        seen = np.unique(text[order], return_index=True)[1]  # of text 0, 1, ...: its first place in the order
        by_age = np.argsort(seen)
        names = list(number)
        mask = np.empty(len(names), np.int64)
        mask[by_age] = later_windows([names[i] for i in by_age.tolist()], np.array(anchors)[by_age], np.array(counts)[by_age], depth)
        out = (1 << np.array(counts, np.int64))[text] - 1
        earliest = order[seen]
        out[earliest] = mask[text[earliest]]
        kept = np.flatnonzero(out)
        kept = kept[np.argsort(chunk[kept], kind="stable")]
        edge = np.flatnonzero(np.diff(chunk[kept], prepend=-1, append=-1)) if len(kept) else np.zeros(1, np.int64)
        lists = lambda a: pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(a[kept], pa.int32()))
        return pa.Table.from_arrays([pa.array(chunk[kept][edge[:-1]], pa.int32()), lists(doc), lists(first), lists(out)], ["chunk", "docs", "firsts", "masks"])

    return run


def _windows(depth: int):
    """The windows whose short prefixes are too frequent, each by 128 bits of its words."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        names = ["k1", "k2", "lost", "doc_id", "chunk", "doc", "first"]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        hot = _told(told, True) if told.num_rows else ()
        if not docs.num_rows or not len(hot):
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names)
        c = Chunk(docs, depth)
        mine = _is_in(c.key, hot)
        start, n, doc = c.start[mine], c.n[mine], np.repeat(c.doc[mine], c.n[mine])
        at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        keys = [window_hashes(h, depth)[at].view(np.int64) for h in (c.h, mix(c.h ^ OTHER))]
        ids = [c.ids[d] for d in doc.tolist()]
        cols = [*keys, [i is None for i in ids], ids, np.full(len(doc), docs.column("chunk")[0].as_py()), doc, at - c.base[doc]]
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names)

    return run


def _removals(depth: int):
    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        names = ["doc_id", "n_words", "n_removed", "kept_text"]
        if not docs.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.string())], names)
        c = Chunk(docs, depth, hashed=False)
        doc, first, mask = (np.asarray(marks.column(x).combine_chunks().flatten(), np.int64) for x in ("docs", "firsts", "masks"))
        which, bit = np.nonzero(mask[:, None] >> np.arange(depth - PREFIX + 1) & 1)
        start = (c.base[doc] + first)[which] + bit
        edge = np.zeros(len(c.words) + 1, np.int32)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + depth, -1)
        gone = np.cumsum(edge)[:-1] > 0
        left = np.concatenate([[0], np.cumsum(~gone)])[c.base]
        kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), c.words.filter(pa.array(~gone)).cast(pa.string())), " ")
        return pa.Table.from_arrays([pa.array(c.ids, pa.int64()), pa.array(c.sizes), pa.array(c.sizes - np.diff(left)), kept], names)

    return run


def remove_repeats(docs: DataFrame, depth: int = 20, chunk_bytes: int = 4 << 20, group: int = GROUP) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) per row: words covered by a run of `depth` words that also starts earlier are removed.

    Earlier is a smaller doc_id, or the same document and an earlier start. All is judged on the input.

    Suffixes begin at the anchors of windows (see Chunk): every window hangs at one anchor, and equal windows at equal
    anchors, so the trees of these suffixes hold all repeats of `depth` words or more. They are split by prefixes of
    variable length: PREFIX words first; chunks tell their prefixes with their numbers of suffixes, and prefixes that only
    one suffix of the corpus has are done. Prefixes are put together into groups of about `group` suffixes, each one task:
    it sorts its suffixes' words, finds their common lengths, and the internal nodes that are deep enough, `depth` words with
    what stands before the anchor, are the repeats; neighbouring ones join to maximal repeats when the covered words are
    marked. A prefix with more than `group` suffixes would not fit, so it is lengthened to the whole depth, where it has a
    single leaf, and the earliest of its windows is an aggregate, made on the map side first.

    Documents are dealt into chunks of about chunk_bytes. Rows with equal doc_ids are different documents, in an order drawn
    from their texts; null ids come last. Null and empty texts have no words. Words are compared as words, at the whole depth
    by 128 bits.
    """
    if not PREFIX < depth <= PREFIX + 31:
        raise ValueError(f"depth must be between {PREFIX + 1} and {PREFIX + 31}")
    packed, chunks = chunked(docs, chunk_bytes)
    by_chunk, n = packed.groupBy("chunk"), tasks_for(chunks)
    keys = by_chunk.applyInArrow(_keys(depth), KEYS)
    # counted before they meet their chunks again, so that a prefix of very many chunks is one row
    shared = keys.groupBy("key").agg(F.sum("n").alias("total")).where("total > 1")
    told = cut(keys.join(shared, "key").select("chunk", "key", (F.col("total") > group).alias("hot"), "n"), "prefixes")
    suffixes, hot = told.agg(F.sum(F.when(~F.col("hot"), F.col("n"))), F.count_if("hot")).first()
    told = told.drop("n").repartition(n, "chunk").groupBy("chunk")
    buckets = max(1, -(-(suffixes or 0) // group))
    packs = by_chunk.cogroup(told).applyInArrow(_packs(depth, buckets), PACKS)
    marks = packs.repartition(tasks_for(buckets), "bucket").groupBy("bucket").applyInArrow(_trees(depth), MARKS)
    if hot:
        windows = cut(by_chunk.cogroup(told).applyInArrow(_windows(depth), WINDOWS), "windows")
        place = F.struct("lost", "doc_id", "chunk", "doc", "first")
        earliest = windows.groupBy("k1", "k2").agg(F.min(place).alias("earliest"))
        later = windows.join(earliest, ["k1", "k2"]).where(place != F.col("earliest"))
        marks = marks.unionByName(later.select("chunk", F.array("doc").alias("docs"), F.array("first").alias("firsts"), F.array(F.lit(1)).alias("masks")))
    return by_chunk.cogroup(marks.repartition(n, "chunk").groupBy("chunk")).applyInArrow(_removals(depth), "doc_id long, n_words long, n_removed long, kept_text string")
