"""SentencePiece ids by an agenda of adjacent symbol pairs, ordered by score, for vocabularies of the merge type."""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from rookery.llm.bpe import gathered, strings

#: A model file is sent to all tasks; none larger than this is taken.
MODEL_BYTES = 64 << 20
#: Words whose ids a Python worker remembers at most, twice over: a full table becomes the old one, and only words met again move on.
WORDS = 200_000
#: Words compared with the library in one call.
CALL = 512
#: Bytes of text taken at a time; a longer text is taken alone.
SLICE_BYTES = 4 << 20
#: Put before a text: nothing, and then what parts it from the text.
NOTHING, GAP = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
#: What a space becomes.
SPACE = "▁"
#: Longer words get an agenda of their own, a heap, as a round over columns takes one pair of each word.
COLUMN_CHARS = 48
#: In place of a score: the pair makes no piece.
NONE = 1 << 40


def model_file(docs: DataFrame, path: str):
    """The model as a broadcast, after a check of its size, and that it is of the merge type, changes nothing but spaces before it
    encodes, and has no piece that reaches over the start of a word, so that words can be encoded apart."""
    with open(path, "rb") as f:
        raw = f.read(MODEL_BYTES + 1)
    if len(raw) > MODEL_BYTES:
        raise ValueError(f"{path}: a model of over {MODEL_BYTES} bytes isn't broadcast")
    model = sentencepiece_model_pb2.ModelProto.FromString(raw)
    trainer, norm = model.trainer_spec, model.normalizer_spec
    kind = sentencepiece_model_pb2.ModelProto.SentencePiece
    if trainer.model_type != trainer.BPE or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix:
        raise ValueError(f"{path}: not a merge vocabulary with bytes for unknown characters")
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
        raise ValueError(f"{path}: its normalizer changes more than spaces")
    if {p.type for p in model.pieces} - {kind.NORMAL, kind.UNKNOWN, kind.CONTROL, kind.BYTE}:
        raise ValueError(f"{path}: pieces of the user's own, or unused ones, aren't supported")
    if any(p.type == kind.NORMAL and SPACE in p.piece.lstrip(SPACE) for p in model.pieces):
        raise ValueError(f"{path}: it has pieces that reach over the start of a word")
    return docs.sparkSession.sparkContext.broadcast(raw)


#: The encoder that this Python worker used last, by its model: one is built per worker, not per batch.
LOADED: dict[bytes, PieceEncoder] = {}


def load(raw: bytes) -> PieceEncoder:
    if raw not in LOADED:
        LOADED.clear()
        LOADED[raw] = PieceEncoder(raw)
    return LOADED[raw]


class PieceEncoder:
    """Ids of texts. A text gets a space in front and is cut where a run of spaces begins; each distinct word is merged once."""

    def __init__(self, raw: bytes):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
        n = range(self.sp.get_piece_size())
        self.byte = {int(self.sp.id_to_piece(i)[3:5], 16): i for i in n if self.sp.is_byte(i)}
        normal = {self.sp.id_to_piece(i): i for i in n if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i))}
        self.rank = {p: -self.sp.get_score(i) for p, i in normal.items()}
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # symbols: pieces by id, then characters that are only parts of pieces; any other character is its negated code point - 1
        parts = sorted({c for p in normal for c in p} - normal.keys())
        self.pieces = len(n)
        self.id = normal | {c: self.pieces + i for i, c in enumerate(parts)}
        self.char = np.array([ord(c) for c in parts], np.int64)
        self.symbol = -1 - np.arange(0x110000, dtype=np.int64)
        for p, i in self.id.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.symbol[ord(" ")] = self.symbol[ord(SPACE)]
        # pairs of symbols that make a piece: (left, right) as one number, in order, with the piece's place by score and its id
        order = {r: k for k, r in enumerate(sorted(set(self.rank.values())))}
        pairs = [
            ((self.id[p[:k]] << 32) | self.id[p[k:]], order[self.rank[p]], i) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in self.id and p[k:] in self.id
        ]
        self.pair, self.pair_rank, self.pair_id = (np.array(x, np.int64) for x in zip(*sorted([*pairs, (1 << 62, NONE, 0)]), strict=True))

    def merged(self, word: str) -> list[str]:
        """The symbols that are left of one word when no two adjacent ones make a piece. The agenda, a heap, holds pairs of adjacent
        symbols that do, the best score first, then the leftmost; a pair is out of date if one of its symbols has been merged."""
        rank = self.rank
        size = [1] * len(word)  # of the symbol that starts here, 0 inside one
        before = list(range(-1, len(word) - 1))  # where the symbol to the left of one starts
        agenda = [(rank[p], i, 2) for i in range(len(word) - 1) if (p := word[i : i + 2]) in rank]
        heapq.heapify(agenda)
        while agenda:
            _, left, total = heapq.heappop(agenda)
            right = left + size[left]
            if right == left or right >= len(word) or size[left] + size[right] != total:
                continue
            size[left], size[right] = total, 0
            after = left + total
            if after < len(word):
                before[after] = left
                if (p := word[left : after + size[after]]) in rank:
                    heapq.heappush(agenda, (rank[p], left, len(p)))
            if left and (p := word[before[left] : after]) in rank:
                heapq.heappush(agenda, (rank[p], before[left], len(p)))
        out, at = [], 0
        while at < len(word):
            out.append(word[at : at + size[at]])
            at += size[at]
        return out

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place by score, id) of the pieces that pairs of symbols make; NONE where they make none."""
        key = np.where((left < 0) | (right < 0), -1, (left << 32) | right)
        at = np.searchsorted(self.pair, key)
        return np.where(self.pair[at] == key, self.pair_rank[at], NONE), self.pair_id[at]

    def merged_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all words end to end, number of each word's): the agendas of many words as columns of pairs. Each round takes
        the first entry of every word's agenda, the best score and leftmost, merges it, and looks up the two new pairs beside it."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.symbol[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        word = np.arange(len(words))
        last = np.cumsum(size) - 1
        rank, made = self._pairs(sym, np.append(sym[1:], -1))
        rank[last] = NONE
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(word):
            first = np.cumsum(size) - size
            best = np.minimum.reduceat(rank, first)
            if (over := best == NONE).any():
                at = np.repeat(over, size)
                done.append((word[over], size[over], sym[at]))
                sym, rank, made = sym[~at], rank[~at], made[~at]
                word, size, best = word[~over], size[~over], best[~over]
                if not len(word):
                    break
            owner = np.repeat(np.arange(len(word)), size)
            at = np.flatnonzero(rank == best[owner])
            at = at[np.flatnonzero(np.diff(owner[at], prepend=-1))]  # the leftmost of each word
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, rank, made = sym[keep], rank[keep], made[keep]
            at -= np.arange(len(at))  # one symbol of each word before has gone
            size = size - 1
            last = np.cumsum(size) - 1
            for i, inner in ((at, at != last), (at[at > last - size + 1] - 1, True)):
                r, m = self._pairs(sym[i], sym[np.minimum(i + 1, len(sym) - 1)])
                rank[i], made[i] = np.where(inner, r, NONE), m
        if not done:
            return sym, size
        word, size, sym = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word)
        return gathered(sym, (np.cumsum(size) - size)[order], size[order]), size[order]

    def word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of words; symbols that aren't pieces become the pieces of their bytes."""
        out: list[bytes] = [b""] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= COLUMN_CHARS]
        sym, n = self.merged_words([words[i] for i in short])
        edge = np.concatenate([[0], np.cumsum(n)])
        plain = (sym >= 0) & (sym < self.pieces)
        body = sym.astype("<u4").tobytes()
        odd = set(np.searchsorted(edge, np.flatnonzero(~plain), side="right").tolist())
        for k, (i, a, b) in enumerate(zip(short, edge.tolist(), edge[1:].tolist(), strict=False)):
            out[i] = body[4 * a : 4 * b] if k + 1 not in odd else self._with_bytes(sym[a:b].tolist())
        for i in (i for i, w in enumerate(words) if len(w) > COLUMN_CHARS):
            out[i] = self._with_bytes([self.id[s] if s in self.id else -1 - ord(s) for s in self.merged(words[i].replace(" ", SPACE))])
        return out

    def _with_bytes(self, symbols: list[int]) -> bytes:
        out = array("I")
        for s in symbols:
            if 0 <= s < self.pieces:
                out.append(s)
            else:
                out.extend(self.byte[b] for b in chr(-1 - s if s < 0 else int(self.char[s - self.pieces])).encode())
        return out.tobytes()

    def _checked(self, words: list[str], ids: list[bytes]) -> None:
        """Compares ids with the library's, CALL words as one text. It puts a space in front itself; words of spaces only end a text."""
        inner = [i for i, w in enumerate(words) if w[-1] != " "]
        calls = [inner[lo : lo + CALL] for lo in range(0, len(inner), CALL)] + [[i] for i, w in enumerate(words) if w[-1] == " "]
        for call in calls:
            text = "".join(words[i] for i in call)[1:]
            if text and array("I", self.sp.encode(text)).tobytes() != b"".join(ids[i] for i in call):
                raise RuntimeError(f"the sentencepiece library encodes words otherwise: {text[:200]!r}")

    def words(self, words: list[str], check: bool) -> list[bytes]:
        """Ids of distinct words that begin with a space."""
        if len(self.known) > WORDS:
            self.old, self.known = self.known, {}
        out = list(map(self.known.get, words))
        new = []
        for i in [i for i, x in enumerate(out) if x is None]:
            x = self.old.get(words[i])
            if x is None:
                new.append(i)
            else:
                self.known[words[i]] = out[i] = x
        if new:
            names = [words[i] for i in new]
            ids = self.word_ids(names)
            if check:
                self._checked(names, ids)
            self.known.update(zip(names, ids, strict=True))
            for i, x in zip(new, ids, strict=True):
                out[i] = x
        return out

    def texts(self, texts: pa.Array, check: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of ids of each); texts is a large_string array without nulls."""
        texts = pc.replace_substring(texts, SPACE, " ")
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(NOTHING, texts, GAP))
        edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        space = np.frombuffer(data, np.uint8)[: edges[-1]] == 32 if edges[-1] else np.zeros(0, bool)
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        begin[edges[:-1][np.diff(edges) > 0]] = True
        begin[: edges[0]] = False
        at = np.flatnonzero(begin)
        words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, edges[-1])), data)
        coded = words.dictionary_encode()
        ids = self.words(strings(coded.dictionary), check)
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        word = np.asarray(coded.indices)
        own = n[word]
        flat = gathered(np.frombuffer(b"".join(ids), "<u4"), (np.cumsum(n) - n)[word], own)
        return flat, np.diff(np.concatenate([[0], np.cumsum(own)])[np.searchsorted(at, edges)])


def sliced(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in stretches of about `most` bytes of a column."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    stretch = (np.cumsum(size) - size) // most
    edges = np.flatnonzero(np.diff(stretch, prepend=-1, append=-1)) if len(size) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(int(a), int(b - a))


def encode_pieces(docs: DataFrame, path: str, end_id: int | None = None, decode: bool = False, check: bool = True) -> DataFrame:
    """(doc_id, ids array<int>) per row, with `decoded` if asked for: ids of the whole text as the sentencepiece library gives
    them without sampling, and end_id behind them if it is given; decoded is what the library makes of these ids.

    A text is a sequence of words that each begin with a run of spaces, one of which is put in front of the text, and no piece
    reaches over the start of a word. Each distinct word of an Arrow batch is merged by an agenda of adjacent pairs; a Python
    worker remembers a bounded number of words. What a worker merges for the first time is compared with the library's ids
    in the same batch (`check`), and the job ends where they differ. Symbols that aren't pieces become the pieces of their bytes. Rows are encoded where they are read:
    nothing is shuffled, and a lost task is done again from its input.

    Null and empty texts have end_id only, or no ids. Repeated rows and null ids are kept row by row; other columns are left out.
    """
    model = model_file(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(model.value)
        for batch in (s for b in batches for s in sliced(b, "text")):
            flat, n = encoder.texts(pc.fill_null(batch.column("text").cast(pa.large_string()), ""), check)
            if end_id is not None:
                flat, n = np.insert(flat, np.cumsum(n), end_id), n + 1
            ends = np.concatenate([[0], np.cumsum(n)])
            cols = [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32)))]
            if decode:
                lists = [flat[a:b].tolist() for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
                cols.append(pa.array(encoder.sp.decode(lists, num_threads=1), pa.string()))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "decoded"][: len(cols)])

    rows = docs.selectExpr("cast(doc_id as bigint) AS doc_id", "text")
    return rows.mapInArrow(run, "doc_id long, ids array<int>" + ", decoded string" * decode)


def decode_pieces(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (doc_id, ids) with `decoded`, as the library decodes the ids. A null list decodes to null."""
    model = model_file(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = load(model.value).sp.decode
        for batch in batches:
            text = [None if x is None else decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], [*batch.schema.names, "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
