"""Encoding through a table of distinct words, and decoding through a table of pieces."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from rookery.llm.chunks import chunked, tasks_for, unpacked

#: A tokenizer file is sent to all tasks; none larger than this is taken.
TOKENIZER_BYTES = 64 << 20
#: Pieces encoded in one call.
CALL = 4096
#: Pieces whose ids a Python worker remembers at most, twice over: a full table becomes the old one, and only pieces met again move on.
PIECES = 500_000
#: The steps before the model for which word by word is the same as the whole text: no step reaches over white space.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPLITTERS = [
    {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
#: Letters below this (Latin, Greek, Cyrillic) are the same in all versions of Unicode in use.
SETTLED = 0x530


def tokenizer_file(docs: DataFrame, path: str):
    """The file's text as a broadcast, after a check of its size, and that it may be applied word by word: other files are refused."""
    with open(path, encoding="utf-8") as f:
        text = f.read(TOKENIZER_BYTES + 1)
    if len(text) > TOKENIZER_BYTES:
        raise ValueError(f"{path}: a tokenizer file of over {TOKENIZER_BYTES} bytes isn't broadcast")
    spec = json.loads(text)
    model = spec["model"]
    if spec["normalizer"] != NORMALIZER or (spec["pre_tokenizer"] or {}).get("pretokenizers") != SPLITTERS or model["type"] != "BPE" or model.get("dropout"):
        raise ValueError(f"{path}: its normalizer, pre-tokenizer or model may reach over white space, so words can't be encoded apart")
    return docs.sparkSession.sparkContext.broadcast(text)


#: The encoder that this Python worker used last, by its file's text: one is built per worker, not per group.
LOADED: dict[str, WordEncoder] = {}


def load(text: str) -> WordEncoder:
    if text not in LOADED:
        LOADED.clear()
        LOADED[text] = WordEncoder(text)
    return LOADED[text]


def gathered(flat: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The stretches flat[first : first + n], end to end."""
    stop = np.cumsum(n)
    return flat[np.repeat(first - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)]


def strings(a: pa.Array) -> list[str]:
    """Python strings of a large_string array without nulls, sliced from one."""
    stop = np.cumsum(np.asarray(pc.utf8_length(a), np.int64)).tolist()
    if not len(a):
        return []
    _, edges, data = a.buffers()
    edges = np.frombuffer(edges, np.int64)[a.offset : a.offset + len(a) + 1]
    text = data.slice(int(edges[0]), int(edges[-1] - edges[0])).to_pybytes().decode()
    return [text[x:y] for x, y in zip([0, *stop], stop, strict=False)]


class WordEncoder:
    """Ids of words, as the tokenizer gives them wherever the word stands in a text; truncation and padding are off.

    Words of ASCII and settled letters are taken to pieces by Arrow, with the file's own pattern, and each distinct piece
    goes to the file's model; what a letter becomes on the way there is asked of the file's normalizer and pre-tokenizer.
    All other words, and those that hold a special token's text, go through the whole tokenizer.
    """

    def __init__(self, text: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_str(text)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.pieces: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        settled, self.byte = "", {}
        for c in map(chr, range(0x80, SETTLED)):
            low = self.tok.normalizer.normalize_str(c)
            cut = self.tok.pre_tokenizer.pre_tokenize_str(low)
            if c.isalpha() and low.isalpha() and len(low) == len(cut) == 1 and pc.utf8_lower(pa.scalar(c)).as_py() == low:
                settled += c
                self.byte[ord(low)] = cut[0][0]
        self.plain = f"^[!-~{settled}]+$"
        self.cut = f"('s|'t|'re|'ve|'m|'ll|'d|[a-z{settled}]+|[0-9]|[^a-z0-9{settled}]+)"
        special = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.special = "|".join(special) or "^$"

    def _piece_ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of distinct pieces end to end, number of ids of each)."""
        names = strings(pieces)
        if len(self.pieces) > PIECES:
            self.old, self.pieces = self.pieces, {"": b""}
        known, old, tokenize, byte = self.pieces, self.old, self.tok.model.tokenize, self.byte
        out = list(map(known.get, names))
        for i in [i for i, x in enumerate(out) if x is None]:
            p = names[i]
            x = old.get(p)
            if x is None:
                x = array("I", [t.id for t in tokenize(p if p.isascii() else p.translate(byte))]).tobytes()
            known[p] = out[i] = x
        return np.frombuffer(b"".join(out), "<u4"), np.fromiter(map(len, out), np.int64, len(out)) // 4

    def _whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of each word's), from texts of many words with spaces between; offsets tell whose each id is."""
        ids, n = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for lo in range(0, len(words), CALL):
            part = words[lo : lo + CALL]
            e = self.tok.encode(" ".join(part), add_special_tokens=False)
            sizes = np.fromiter(map(len, part), np.int64, len(part)) + 1
            at = np.array(e.offsets, np.int64).reshape(-1, 2)[:, 0]
            owner = np.searchsorted(np.cumsum(sizes) - sizes, at, side="right") - 1
            ids.append(np.array(e.ids, "<u4"))
            n.append(np.bincount(owner, minlength=len(part)))
        return np.concatenate(ids), np.concatenate(n)

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat, first, n): word i has the ids flat[first[i] : first[i] + n[i]]; words is a large_string array without nulls."""
        plain = pc.and_not(pc.match_substring_regex(words, self.plain), pc.match_substring_regex(words, self.special))
        one = np.asarray(pc.and_(plain, pc.utf8_is_alpha(words)))
        plain = np.asarray(plain)
        single, signs, odd = (np.flatnonzero(m) for m in (one, plain & ~one, ~plain))
        low = pc.utf8_lower(words.take(pa.array(np.concatenate([single, signs]))))
        marked = pc.split_pattern(pc.replace_substring_regex(low.slice(len(single)), self.cut, "\\1\x00"), "\x00")
        coded = pa.concat_arrays([low.slice(0, len(single)), marked.flatten()]).dictionary_encode()
        ids, size = self._piece_ids(coded.dictionary)
        piece = np.asarray(coded.indices)
        own = size[piece]
        flat = gathered(ids, (np.cumsum(size) - size)[piece], own)
        edge = np.concatenate([np.arange(len(single)), np.asarray(marked.offsets, np.int64) - marked.offsets[0].as_py() + len(single)])
        stop = np.concatenate([[0], np.cumsum(own)])[edge]
        rest, n_rest = self._whole(strings(words.take(pa.array(odd))))
        n = np.zeros(len(words), np.int64)
        first = np.zeros(len(words), np.int64)
        at = np.concatenate([single, signs])
        n[at], first[at] = np.diff(stop), stop[:-1]
        n[odd], first[odd] = n_rest, len(flat) + np.cumsum(n_rest) - n_rest
        return np.concatenate([flat, rest]), first, n

    def documents(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of ids of each). Null texts have none. Arrow splits the texts and numbers their distinct words."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = lists.flatten().dictionary_encode()
        flat, first, n = self.encode(coded.dictionary)
        word = np.asarray(coded.indices)
        own = n[word]
        ends = np.asarray(lists.offsets, np.int64)
        return gathered(flat, first[word], own), np.diff(np.concatenate([[0], np.cumsum(own)])[ends - ends[0]])


def packed_words(words: pa.Array) -> bytes:
    """Words, which hold no space, as one compressed text; and back."""
    return zlib.compress(" ".join(words.to_pylist()).encode(), 1)


def unpacked_words(body: bytes) -> pa.Array:
    return pc.split_pattern(pa.array([zlib.decompress(body).decode()], pa.large_string()), " ").flatten()


def packed_numbers(*parts: np.ndarray) -> bytes:
    """32-bit integers as four runs of bytes, lowest bytes first, compressed: the empty high bytes come together."""
    return zlib.compress(b"".join(a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for a in parts), 1)


def unpacked_numbers(body: np.ndarray) -> np.ndarray:
    return body.reshape(4, -1).T.copy().view("<u4").reshape(-1)


class ChunkWords:
    """A chunk's texts as numbers of its distinct words, which stand by bucket of the word table, then by code points."""

    def __init__(self, bodies: list[bytes], buckets: int):
        lists = pc.ascii_split_whitespace(pa.array(bodies, pa.large_binary()).cast(pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        ordered = pc.sort_indices(coded.dictionary)
        names = coded.dictionary.take(ordered)
        bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in strings(names)), np.int64, len(names))
        order = np.argsort(bucket, kind="stable")
        self.words, self.bucket = names.take(pa.array(order)), bucket[order]
        place = np.empty(len(order), np.int64)
        place[np.asarray(ordered, np.int64)[order]] = np.arange(len(order))
        self.word = place[np.asarray(coded.indices)]
        self.ends = np.asarray(lists.offsets, np.int64)

    def runs(self) -> list[tuple[int, int, int]]:
        """(bucket, first word, end)."""
        edge = np.flatnonzero(np.diff(self.bucket, prepend=-1, append=-1)).tolist() if len(self.bucket) else [0]
        return [(int(self.bucket[a]), a, b) for a, b in zip(edge, edge[1:], strict=False)]


def _words(buckets: int):
    """A row per bucket: the chunk's distinct words there, compressed."""

    def run(chunk: pa.Table) -> pa.Table:
        c = ChunkWords(unpacked(chunk)[1], buckets)
        runs = c.runs()
        return pa.table({
            "bucket": pa.array([r[0] for r in runs], pa.int32()), "chunk": pa.array([chunk.column("chunk")[0].as_py()] * len(runs), pa.int32()),
            "words": pa.array([packed_words(c.words.slice(a, b - a)) for _, a, b in runs], pa.binary()),
        })

    return run


def _encode(tokenizer):
    """A bucket of the table of distinct words: each is encoded once, and each chunk gets the ids of its words back in its order."""

    def run(bucket: pa.Table) -> pa.Table:
        lists = [unpacked_words(b) for b in bucket.column("words").to_pylist()]
        coded = pa.concat_arrays(lists).dictionary_encode()
        flat, first, n = load(tokenizer.value).encode(coded.dictionary)
        word, at, out = np.asarray(coded.indices), 0, []
        for own in lists:
            mine = word[at : at + len(own)]
            at += len(own)
            out.append(packed_numbers(n[mine], gathered(flat, first[mine], n[mine])))
        return pa.table({"chunk": bucket.column("chunk"), "bucket": bucket.column("bucket"), "ids": pa.array(out, pa.binary())})

    return run


def _decoded(tok: Tokenizer, raw: list[bytes | None]) -> pa.Array:
    """Each list of ids joined to the table of pieces by id, in order."""
    pieces = pa.array([tok.id_to_token(i) for i in range(tok.get_vocab_size())], pa.string())
    ids = np.frombuffer(b"".join(b or b"" for b in raw), "<u4")
    ends = np.cumsum([0, *(len(b or b"") // 4 for b in raw)])
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pieces.take(pa.array(ids))), " ")
    return pc.if_else(pa.array([b is not None for b in raw], pa.bool_()), text, pa.scalar(None, pa.string()))


def _place(buckets: int, tokenizer, decode: bool):
    """Ids joined back to a chunk's documents, word by word; then, if asked, decoded from the ids."""

    def run(docs: pa.Table, table: pa.Table) -> pa.Table:
        names = ["doc_id", "ids"] + ["decoded"] * decode
        if not docs.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for k in (pa.int64(), pa.binary(), pa.string())][: len(names)], names)
        ids, bodies = unpacked(docs)
        c = ChunkWords(bodies, buckets)
        del bodies
        size = {b: y - x for b, x, y in c.runs()}
        n, flat = [np.zeros(0, np.int64)], [np.zeros(0, "<u4")]
        for b, body in sorted(zip(table.column("bucket").to_pylist(), table.column("ids").to_pylist(), strict=True)):
            raw = np.frombuffer(zlib.decompress(body), np.uint8)
            n.append(unpacked_numbers(raw[: 4 * size[b]]).astype(np.int64))
            flat.append(unpacked_numbers(raw[4 * size[b] :]))
        n, flat = np.concatenate(n), np.concatenate(flat)
        own = n[c.word]
        all_ids = gathered(flat, (np.cumsum(n) - n)[c.word], own).astype("<u4").tobytes()
        ends = (4 * np.concatenate([[0], np.cumsum(own)])[c.ends]).tolist()
        out = [all_ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        cols = [pa.array(ids, pa.int64()), pa.array(out, pa.binary())]
        return pa.Table.from_arrays(cols + [_decoded(load(tokenizer.value).tok, out)] * decode, names)

    return run


def encode_documents(docs: DataFrame, path: str, chunk_bytes: int = 4 << 20, decode: bool = False) -> DataFrame:
    """(doc_id, ids) per row, with `decoded` as decode_documents gives it if asked for: ids of the whole text as little-endian unsigned 32-bit integers, without special tokens added.

    Text is split into words at spaces and 0x09-0x0D, over which no step of the tokenizer reaches, so a text's ids are
    its words' ids end to end. Documents are dealt into chunks of about chunk_bytes; a chunk sends each of its distinct
    words once to the bucket of the distinct-word table that the word hashes to, where every word of the corpus is encoded
    once; the ids come back to the chunks that asked and are joined to the words by position.

    Null and empty texts have no ids. Repeated rows and null ids are kept row by row; other columns are ignored.
    """
    tokenizer = tokenizer_file(docs, path)
    packed, chunks = chunked(docs, chunk_bytes)
    by_chunk = packed.groupBy("chunk")
    words = by_chunk.applyInArrow(_words(chunks), "bucket int, chunk int, words binary")
    n = tasks_for(chunks)
    table = words.repartition(n, "bucket").groupBy("bucket").applyInArrow(_encode(tokenizer), "chunk int, bucket int, ids binary")
    return by_chunk.cogroup(table.repartition(n, "chunk").groupBy("chunk")).applyInArrow(_place(chunks, tokenizer, decode), "doc_id long, ids binary" + ", decoded string" * decode)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (doc_id, ids) with `decoded`: the pieces of the ids, special ones too, joined by spaces.

    The id-to-piece table has one row per id of the vocabulary, which bounds it, and is joined on the map side.
    """
    tokenizer = tokenizer_file(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(tokenizer.value).tok
        for batch in batches:
            out = _decoded(tok, batch.column("ids").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, "doc_id long, ids binary, decoded string")
