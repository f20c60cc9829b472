"""How filters of documents overlap, over a sparse document-term matrix."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rookery.llm.bpe import unpacked_numbers
from rookery.llm.storage import cut
from rookery.llm.words import mix

#: Text in a shard of the matrix; a longer text is a shard of its own.
SHARD_BYTES = 16 << 20
FILTERS = "ABCDE"
#: Odd factors by which bytes count at their places in a word, for its bucket.
PLACES = np.random.default_rng(13).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
ROW = "struct<doc_id:bigint,part:string,c:boolean,d:boolean,digest:binary>"
ROW_TYPE = pa.struct([("doc_id", pa.int64()), ("part", pa.string()), ("c", pa.bool_()), ("d", pa.bool_()), ("digest", pa.binary())])
LOCAL = f"shard bigint, rows array<{ROW}>, first binary, columns binary, counts binary, words binary"
MATRIX = f"shard bigint, rows array<{ROW}>, first array<int>, terms array<bigint>, counts array<int>"


def _lists(edges: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values)


def _one(values: pa.Array) -> pa.Array:
    """A column of one row that holds all values."""
    return _lists(np.array([0, len(values)]), values)


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit integers as four runs of bytes, lowest bytes first, so that the empty ones compress to nothing; unpacked_numbers reads them."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(body: bytes) -> np.ndarray:
    return unpacked_numbers(np.frombuffer(body, np.uint8)).astype(np.int64)


def _joined(words: pa.Array) -> bytes:
    """Words, which hold no space, as one text."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.scalar(" ", words.type))[0].as_py().encode()


def _split(body: bytes) -> pa.Array:
    text = pa.array([body.decode()], pa.large_string())
    return pc.split_pattern(text, " ").flatten() if body else pa.array([], pa.large_string())


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows in stretches of about `most` bytes of text, over the batches of a task."""
    held, size = [], 0
    for batch in batches:
        own = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), np.int64)
        lo = 0
        for i, n in enumerate(own.tolist()):
            if size and size + n > most:
                yield pa.Table.from_batches([*held, batch.slice(lo, i - lo)])
                held, size, lo = [], 0, i
            size += n
        held.append(batch.slice(lo))
    if held and sum(map(len, held)):
        yield pa.Table.from_batches(held)


def _local_shards(most: int):
    """A row per shard: its documents with what doesn't need the matrix, and its part of the matrix in compressed rows, whose columns
    are the shard's own distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, table in enumerate(_gathered(batches, most)):
            text = pc.fill_null(table.column("text").cast(pa.large_string()), "").combine_chunks()
            edges = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
            edges = edges - edges[0]
            capitals = np.flatnonzero((data >= 65) & (data <= 90))
            c = 100 * np.diff(np.searchsorted(capitals, edges)) > 3 * np.asarray(pc.utf8_length(text), np.int64)
            digest = [hashlib.sha256(data[a:b]).digest() for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False)]
            part = pc.fill_null(table.column("lang").combine_chunks(), "")
            rows = pa.StructArray.from_arrays(
                [table.column("doc_id").combine_chunks(), part, pa.array(c), pc.match_substring_regex(text, "[#$%&*|]"), pa.array(digest, pa.binary())], fields=list(ROW_TYPE)
            )
            lists = pc.ascii_split_whitespace(text)
            coded = lists.flatten().dictionary_encode()
            word = np.asarray(coded.indices, np.int64)
            names, empty = coded.dictionary, coded.dictionary.index(pa.scalar("", pa.large_string())).as_py()
            owner = np.repeat(np.arange(len(text)), np.diff(np.asarray(lists.offsets, np.int64)))
            if empty >= 0:  # around the words of a text that begins or ends with a space
                owner, word = owner[word != empty], word[word != empty]
                names = pa.concat_arrays([names.slice(0, empty), names.slice(empty + 1)])
                word -= word > empty
            wide = max(len(names), 1)
            cell, counts = np.unique(owner * wide + word, return_counts=True)
            first = np.searchsorted(cell, np.arange(len(text) + 1) * wide)
            shard = TaskContext.get().partitionId() << 32 | k
            body = [pa.array([b], pa.binary()) for b in (*map(_planes, (first, cell % wide, counts)), _joined(names))]
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), _one(rows), *body], ["shard", "rows", "first", "columns", "counts", "words"])
            pa.default_memory_pool().release_unused()

    return run


def _buckets(words: pa.Array, buckets: int) -> np.ndarray:
    """Bucket of each word, from a sum over its bytes by place."""
    edges = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[edges[0] : edges[-1]]
    place = np.arange(len(data)) - np.repeat(edges[:-1] - edges[0], np.diff(edges))
    shares = (data.astype(np.uint64) + np.uint64(1)) * PLACES[place % len(PLACES)]
    return (mix(np.add.reduceat(shares, edges[:-1] - edges[0])) % np.uint64(buckets)).astype(np.int64)


def _by_bucket(buckets: int):
    """A row per shard and bucket of the dictionary: the shard's words that hash there, and their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, body in zip(batch.column("shard").to_pylist(), batch.column("words"), strict=True):
                names = _split(body.as_py())
                if not len(names):
                    continue
                bucket = _buckets(names, buckets)
                order = np.argsort(bucket, kind="stable")
                edge = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1)).tolist()
                runs = [order[a:b] for a, b in zip(edge, edge[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(bucket[r[0]]) for r in runs], pa.int32()), pa.array([shard] * len(runs), pa.int64()),
                        pa.array([_joined(names.take(pa.array(r))) for r in runs], pa.binary()), pa.array(list(map(_planes, runs)), pa.binary()),
                    ],
                    ["bucket", "into", "words", "columns"],
                )
            pa.default_memory_pool().release_unused()

    return run


def _numbered(bucket: pa.Table) -> tuple[pa.Array, list[np.ndarray]]:
    """(the bucket's distinct words in order, the places of each row's words among them): a word's place doesn't depend on how rows arrive."""
    lists = [_split(b) for b in bucket.column("words").to_pylist()]
    coded = pa.concat_arrays(lists).dictionary_encode()
    order = np.asarray(pc.sort_indices(coded.dictionary), np.int64)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    ends = np.cumsum(list(map(len, lists)))[:-1]
    return coded.dictionary.take(pa.array(order)), np.split(place[np.asarray(coded.indices)], ends)


def _term(bucket: int, place: np.ndarray) -> np.ndarray:
    return np.int64(bucket) << 32 | place


def _terms(bucket: pa.Table) -> pa.Table:
    _, places = _numbered(bucket)
    return pa.table({"into": bucket.column("into"), "bucket": bucket.column("bucket"), "columns": bucket.column("columns"), "places": pa.array(list(map(_planes, places)), pa.binary())})


def _dictionary(bucket: pa.Table) -> pa.Table:
    words, _ = _numbered(bucket)
    return pa.table({"word": words.cast(pa.string()), "term": pa.array(_term(bucket.column("bucket")[0].as_py(), np.arange(len(words))))})


def _encoded(shard: pa.Table, terms: pa.Table) -> pa.Table:
    """The shard with the dictionary's terms in place of its own columns; terms of a row in order."""
    if not shard.num_rows:
        return pa.table({n: pa.array([], t) for n, t in zip(("shard", "rows", "first", "terms", "counts"), (pa.int64(), pa.list_(ROW_TYPE), *(pa.list_(x) for x in (pa.int32(), pa.int64(), pa.int32()))), strict=True)})
    column, count, first = (_numbers(shard.column(c)[0].as_py()) for c in ("columns", "counts", "first"))
    wide = 1 + (int(column.max()) if len(column) else 0)
    term = np.zeros(wide, np.int64)
    for bucket, columns, places in zip(*(terms.column(c).to_pylist() for c in ("bucket", "columns", "places")), strict=True):
        term[_numbers(columns)] = _term(bucket, _numbers(places))
    rank = np.empty(wide, np.int64)
    rank[np.argsort(term)] = np.arange(wide)
    order = np.argsort(np.repeat(np.arange(len(first) - 1), np.diff(first)) * wide + rank[column])
    cols = [shard.column("shard"), shard.column("rows"), *(_one(pa.array(x.astype(t))) for x, t in ((first, np.int32), (term[column[order]], np.int64), (count[order], np.int32)))]
    return pa.table(cols, names=["shard", "rows", "first", "terms", "counts"])


def document_term_matrix(docs: DataFrame, shard_bytes: int = SHARD_BYTES, then=None, schema: str = MATRIX) -> tuple[DataFrame, DataFrame]:
    """(shards, dictionary): the numbers of each word in each document as compressed sparse rows.

    A shard is a row: `rows` are its documents (doc_id, part: lang or '', c and d: whether the filters of that name fail, digest:
    SHA-256 of the text), document i has the entries first[i] to first[i + 1] of `terms`, in order, and `counts`. dictionary is (word,
    term): each distinct word of the whole table once, with a number of its own; numbers aren't gapless.

    A task cuts what it reads into shards of about shard_bytes of text and counts words inside them; texts go no further. A shard sends
    each of its distinct words once to the bucket of the dictionary that the word hashes to; a word's number is its bucket and its
    place among the bucket's words in order. There is a bucket per shard, so a bucket is as large as a shard's words whatever the
    size of the table, and a frequent word meets one entry per shard, not per occurrence. Null texts are empty; null and
    repeated ids are kept row by row. `then` turns each shard into rows of `schema` in the task that has built it.
    """
    rows = docs.selectExpr("cast(doc_id as bigint) AS doc_id", "text", "lang")
    local = cut(rows.mapInArrow(_local_shards(shard_bytes), LOCAL), "shards")
    n = max(8, local.count())
    asked = local.select("shard", "words").mapInArrow(_by_bucket(n), "bucket int, into bigint, words binary, columns binary")
    by_bucket = asked.repartition(n, "bucket").groupBy("bucket")
    terms = by_bucket.applyInArrow(_terms, "into bigint, bucket int, columns binary, places binary").repartition(n, "into")
    shards = local.drop("words").repartition(n, "shard").groupBy("shard").cogroup(terms.groupBy("into"))
    shards = shards.applyInArrow((lambda shard, terms: then(_encoded(shard, terms))) if then else _encoded, schema)
    return shards, by_bucket.applyInArrow(_dictionary, "word string, term bigint")


COUNTED = "doc_id bigint, part string, c boolean, d boolean, digest binary, n_words bigint, n_distinct bigint"


def _row_counts(shard: pa.Table) -> pa.Table:
    """A row per document of a shard, with its row sum and its number of entries."""
    rows = shard.column("rows").combine_chunks().flatten().flatten()
    first, count = (np.asarray(shard.column(c).combine_chunks().flatten(), np.int64) for c in ("first", "counts"))
    ends = np.concatenate([[0], np.cumsum(count)])[first]
    return pa.table([*rows, pa.array(np.diff(ends), pa.int64()), pa.array(np.diff(first), pa.int64())], names=[c.split()[0] for c in COUNTED.split(", ")])


def document_flags(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, part, digest, n_words, n_distinct, mask) per row, of the matrix: mask has bit 0 for filter A to bit 3 for D."""
    counted, _ = document_term_matrix(docs, shard_bytes, _row_counts, COUNTED)
    bits = [F.col("n_words") < 200, 100 * F.col("n_distinct") < 50 * F.col("n_words"), F.col("c"), F.col("d")]
    mask = sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0))
    return counted.select("doc_id", "part", "digest", "n_words", "n_distinct", mask.alias("mask"))


def fail_counts(docs: DataFrame, labels: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters they fail, bit 4 for E, with those of quality 1 and toxic 1.

    Copies of a text are summed by labels before the texts' smallest ids are looked up, so a text with very many copies is a few rows.
    A document under an id that several rows of labels name is good, or toxic, if one of them says so.
    """
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    flags = document_flags(docs, shard_bytes).groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    flags = flags.join(marks, "doc_id", "left").fillna(False, ["good", "toxic"])
    own = F.struct("doc_id", "n")
    texts = flags.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), own)).alias("least"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("n_null")
    )
    texts = cut(texts, "texts")
    low = texts.groupBy("digest").agg(F.min("least.doc_id").alias("low"))
    at_low = F.when(F.col("least.doc_id") == F.col("low"), F.col("least.n")).otherwise(0)
    first = at_low + F.col("n_null")
    both = F.array(F.struct(F.col("mask").alias("mask"), first.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - first).alias("n")))
    split = texts.join(low, "digest").select("part", "good", "toxic", F.inline(both)).where("n > 0")
    counts = [F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")]
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), *counts)


def filter_interactions(docs: DataFrame, labels: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): for each value of lang, null as
    the empty string, each order of the five filters and each step, what the filter at that step removes and what it adds to the others.

    A: under 200 words; B: 100 * distinct words < 50 * words; C: 100 * capitals A-Z > 3 * code points; D: holds any of #$%&*|; E: the
    text of a document with a smaller id. A null text is empty. A null id is no smaller than any other, and no id is smaller than it, so
    it neither fails E nor makes others fail; rows under one id don't make each other fail. An empty table gives no row.
    """
    steps = [(o, k + 1, sum(1 << FILTERS.index(x) for x in o[:k]), 1 << FILTERS.index(o[k])) for o in map("".join, permutations(FILTERS)) for k in range(len(o))]
    named = ", ".join(f"struct('{o}' AS filter_order, {k} AS step, {before} AS before, {own} AS own)" for o, k, before, own in steps)
    each = fail_counts(docs, labels, shard_bytes).selectExpr("*", f"inline(array({named}))")
    fails, earlier = F.col("mask").bitwiseAND(F.col("own")) > 0, F.col("mask").bitwiseAND(F.col("before")) > 0
    total = lambda when, what, name: F.sum(F.when(when, F.col(what)).otherwise(0)).alias(name)
    told = each.groupBy("part", "filter_order", "step", "own").agg(
        total(~fails & ~earlier, "n", "kept"), total(fails & ~earlier, "n", "removed"), total(fails & earlier, "n", "redundant"),
        total(F.col("mask") == F.col("own"), "n", "unique_fails"), total(fails & ~earlier, "good", "good_lost"), total(fails & ~earlier, "toxic", "toxic_lost"),
    )
    return told.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "own"))).drop("own")
