"""Readers of packed position records: 40-byte records, and chunks of delta-coded games.

Files are opened with Arrow's file systems (local paths, hdfs, s3, gs), so tasks seek to what they need.
"""

from __future__ import annotations

import operator
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from rookery.sources.chess_rules import BLACK_LONG, BLACK_SHORT, WHITE_LONG, WHITE_SHORT, Board

RECORD = 40
MAGIC, HEAD, STEM = b"BINP", 8, 34
#: Fixed value: a chunk header that claims more is an error.
LARGEST_CHUNK = 100 << 20
#: A game's number is file << FILE_SHIFT | chunk << CHUNK_SHIFT | stem: 2**19 files of 2**22 chunks; a chunk can't hold 2**22 stems.
FILE_SHIFT, CHUNK_SHIFT = 44, 22
#: The number of files that have none, as they arrive.
NO_FILE = -1
#: Bytes of a file that make a partition of the data source, and the most partitions of one file.
PARTITION_BYTES, PARTITIONS_PER_FILE = 64 << 20, 64
#: Bytes of chunks or records, some 30 000 positions, that make a task of a reader; bytes of records that are one range.
TASK_BYTES, RANGE = 1 << 20, RECORD * 20_000
MOVE = pa.struct([("from", pa.int32()), ("to", pa.int32()), ("type", pa.string()), ("promo", pa.int32())])
SCHEMA = "game_id long, ply int, fen string, move struct<from:int,to:int,type:string,promo:int>, score int, result int, path string, chunk_no long, pos_in_chunk int"
#: Move types by the two bits of either format.
FIXED_TYPES = ("normal", "promotion", "en_passant", "castle")
PACKED_TYPES = ("normal", "promotion", "castle", "en_passant")


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.string(), MOVE, pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int32()]
    names = ["game_id", "ply", "fen", "move", "score", "result", "path", "chunk_no", "pos_in_chunk"]
    cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
    frm, to, kind, promo = zip(*cols[3], strict=True) if rows else [()] * 4
    promo = pa.array([None if x < 0 else x for x in promo], pa.int32())
    cols[3] = pa.StructArray.from_arrays([pa.array(frm, pa.int32()), pa.array(to, pa.int32()), pa.array(kind, pa.string()), promo], fields=list(MOVE))
    return pa.RecordBatch.from_arrays([c if k is MOVE else pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def fixed_record(raw: bytes) -> tuple[str, tuple[int, int, str, int], int, int, int]:
    """(fen, move, score, ply, result) of a 40-byte record. Bits run from the low end of each byte: the side to move, the kings,
    the other squares from a8 (a set first bit is followed by three of the piece and one of the colour), rights, en passant, counters."""
    score, packed, ply, result = struct.unpack_from("<hHHb", raw, 32)
    kind = FIXED_TYPES[packed >> 14]
    to, frm = packed & 63, packed >> 6 & 63
    promoted = (1 + (packed >> 12 & 3)) * 2 + (to // 8 != 7) if kind == "promotion" else -1
    return _fixed_fen(bytes(raw[:32])), (frm, to, kind, promoted), score, ply, result


@lru_cache(1 << 14)
def _fixed_fen(raw: bytes) -> str:
    """The FEN of a record's first 32 bytes; positions that recur are remembered."""
    bits, at = int.from_bytes(raw, "little"), 0

    def take(n: int) -> int:
        nonlocal at
        at += n
        return bits >> (at - n) & ((1 << n) - 1)

    side, pieces = take(1), [-1] * 64
    for king in (10, 11):
        pieces[take(6)] = king
    for sq in (r * 8 + f for r in range(7, -1, -1) for f in range(8)):
        if pieces[sq] < 0 and take(1):
            pieces[sq] = take(3) * 2 + take(1)
    rights = sum(take(1) * r for r in (WHITE_SHORT, WHITE_LONG, BLACK_SHORT, BLACK_LONG))
    ep = take(6) if take(1) else -1
    rule50, full = take(6), take(8)
    full |= take(8) << 8
    rule50 |= take(1) << 6
    return Board(pieces, side, rights, ep, rule50, 2 * (max(full, 1) - 1) + side).fen()


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it) of a path as Spark writes it."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path)


def read_fixed_records(spark: SparkSession, path: str) -> DataFrame:
    """Rows of SCHEMA from files of 40-byte records, cut into ranges of bytes that are dealt over tasks, each read where it lies. A file that
    ends inside a record is an error. A record knows no game, chunk or path: those are null."""
    files = _files(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["length"] % RECORD:
                    raise ValueError(f"{r['path']} ends inside a record")
                fs, name = opened(r["path"])
                with fs.open_input_file(name) as f:
                    for at in range(r["at"], min(r["at"] + RANGE, r["length"]), RECORD * 10_000):
                        f.seek(at)
                        raw = f.read(min(RECORD * 10_000, r["at"] + RANGE - at))
                        decoded = (fixed_record(raw[i : i + RECORD]) for i in range(0, len(raw), RECORD))
                        yield _table([(None, ply, fen, move, score, result, None, None, None) for fen, move, score, ply, result in decoded])

    ranges = files.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(RANGE).cast("long"))).alias("at"))
    return ranges.repartition(_tasks(files), "path", "at").mapInArrow(run, SCHEMA)


def _tasks(files: DataFrame, length: str = "length") -> int:
    """Tasks that files' bytes are dealt over, a megabyte each. The rows that name them are few and small, so Spark, left to choose, would put
    them together in a task or two."""
    size = files.agg(F.sum(length)).first()[0] or 0
    return min(4096, max(files.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))


def chunk_heads(file, length: int) -> Iterator[tuple[int, int, int]]:
    """(chunk_no, offset of the payload, size) of each chunk of an open file: heads are read, payloads skipped; a wrong magic or
    size is an error."""
    at = n = 0
    while at < length:
        file.seek(at)
        head = file.read(HEAD)
        if head[:4] != MAGIC:
            raise ValueError(f"no chunk begins at {at}")
        size = int.from_bytes(head[4:8], "little")
        if len(head) < HEAD or size > LARGEST_CHUNK or at + HEAD + size > length:
            raise ValueError(f"the chunk at {at} claims {size} bytes")
        yield n, at + HEAD, size
        at, n = at + HEAD + size, n + 1


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file_no, path, length): one row per file, numbered by path. Contents aren't read."""
    files = spark.read.format("binaryFile").load(paths).select("path", "length")
    return files.withColumn("file_no", F.row_number().over(W.orderBy("path")) - 1)


INDEX = "file_no int, path string, chunk_no long, offset long, size long"


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks of files (file_no, path, length), by walking their heads."""
    for batch in batches:
        for no, path, length in zip(*(batch.column(c).to_pylist() for c in ("file_no", "path", "length")), strict=True):
            fs, name = opened(path)
            with fs.open_input_file(name) as f:
                heads = list(chunk_heads(f, length))
            for lo in range(0, len(heads), 100_000):
                n, at, size = zip(*heads[lo : lo + 100_000], strict=True)
                yield pa.RecordBatch.from_pydict({"file_no": pa.array([no] * len(n), pa.int32()), "path": [path] * len(n), "chunk_no": pa.array(n, pa.int64()), "offset": pa.array(at, pa.int64()), "size": pa.array(size, pa.int64())})


def _index(files: DataFrame) -> DataFrame:
    dealt = files.repartition(max(1, min(files.count(), _tasks(files))), "path")
    return dealt.select("file_no", "path", "length").mapInArrow(_heads, INDEX)


def binpack_chunk_index(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, chunk_no, offset, size) of all chunks, from their heads alone, each file walked by one task; files may be of any size."""
    return _index(_files(spark, paths)).drop("file_no")


def stem(raw: bytes) -> tuple[Board, tuple[int, int, str, int], int, int]:
    """(board, move, score, result) of the 32 bytes that begin a game: occupied squares, a nibble per piece, move, score, ply and
    result, halfmove clock. Nibble 12 is a pawn just moved two squares, 13 and 14 are rooks with their castling right, 15 is the
    black king with black to move."""
    pieces, side, rights, ep = _stem_board(bytes(raw[:24]))
    packed, score, ply_result, rule50 = struct.unpack(">HHHH", raw[24:32])
    ply = ply_result & 0x3FFF
    kind, frm, to = PACKED_TYPES[packed >> 14], packed >> 8 & 63, packed >> 2 & 63
    promoted = (1 + (packed & 3)) * 2 + (to // 8 != 7) if kind == "promotion" else -1
    return Board(list(pieces), side, rights, ep, rule50, ply), (frm, to, kind, promoted), _signed(score), _signed(ply_result >> 14)


@lru_cache(1 << 14)
def _stem_board(raw: bytes) -> tuple[tuple[int, ...], int, int, int]:
    """(pieces, side, rights, en-passant square) of a stem's first 24 bytes; positions that recur are remembered."""
    occupied = int.from_bytes(raw[:8], "big")
    pieces, side, rights, ep, k = [-1] * 64, 0, 0, -1, 0
    for sq in range(64):
        if not occupied >> sq & 1:
            continue
        nibble = raw[8 + k // 2] >> 4 * (k % 2) & 15
        k += 1
        if nibble == 12:
            pieces[sq], ep = (0, sq - 8) if sq // 8 == 3 else (1, sq + 8)
        elif nibble == 13:
            pieces[sq], rights = 6, rights | (WHITE_LONG if sq == 0 else WHITE_SHORT)
        elif nibble == 14:
            pieces[sq], rights = 7, rights | (BLACK_LONG if sq == 56 else BLACK_SHORT)
        elif nibble == 15:
            pieces[sq], side = 11, 1
        else:
            pieces[sq] = nibble
    return tuple(pieces), side, rights, ep


def _signed(v: int) -> int:
    """The sign is in the lowest bit."""
    return -(v >> 1) - 1 if v & 1 else v >> 1


class _Bits:
    """Reads bits from the high end of each byte."""

    def __init__(self, body: bytes, at: int):
        self.body, self.at = body, 8 * at

    def take(self, n: int) -> int:
        """The next n bits, 24 at most."""
        first, used = divmod(self.at, 8)
        self.at += n
        if self.at > 8 * len(self.body):
            raise ValueError("a chunk ends inside a move list")
        word = int.from_bytes(self.body[first : first + 4].ljust(4, b"\0"), "big")
        return word >> 32 - used - n & (1 << n) - 1

    def number(self, block: int = 4) -> int:
        out = shift = 0
        while True:
            part = self.take(block + 1)
            out |= (part & (1 << block) - 1) << shift
            if not part >> block:
                return out & 0xFFFF
            shift += block

    def end(self) -> int:
        return -(-self.at // 8)


def _choice(bits: _Bits, n: int) -> int:
    return bits.take((n - 1).bit_length()) if n > 1 else 0


def _next_move(board: Board, bits: _Bits) -> tuple[int, int, str, int]:
    """A move as the number of its piece and the number of its target among those it has."""
    own = board.own()
    sq = own[_choice(bits, len(own))]
    kind = board.pieces[sq] // 2
    if kind == 0:
        to = board.pawn_moves(sq)
        if sq // 8 == (6 if board.side == 0 else 1):
            n = _choice(bits, 4 * len(to))
            return sq, to[n // 4], "promotion", (1 + n % 4) * 2 + board.side
        target = to[_choice(bits, len(to))]
        return sq, target, "en_passant" if target == board.ep else "normal", -1
    to = board.attacks(sq)
    rooks = board.castlings() if kind == 5 else []
    n = _choice(bits, len(to) + len(rooks))
    return (sq, to[n], "normal", -1) if n < len(to) else (sq, rooks[n - len(to)], "castle", -1)


def _plies(payload: bytes) -> Iterator[tuple[int, Board, tuple[int, int, str, int], int, int]]:
    """(stem_no, board, move, score, result) of each ply of a chunk: stems, each followed by its number of further plies and their
    moves. A score is coded as its difference from the negative of the one before; the result turns its sign every ply."""
    at = n = 0
    while at + STEM <= len(payload):
        board, move, score, result = stem(payload[at : at + 32])
        plies = int.from_bytes(payload[at + 32 : at + STEM], "big")
        at += STEM
        bits = _Bits(payload, at)
        for k in range(plies + 1):
            if k:
                board.play(move)
                move = _next_move(board, bits)
                score = (-score + _signed(bits.number()) + 0x8000 & 0xFFFF) - 0x8000
                result = -result
            yield n, board, move, score, result
        at, n = bits.end(), n + 1


def chunk_rows(payload: bytes, keep: Callable[[int, int, int], bool] | None = None) -> Iterator[tuple[int, int, int, str, tuple, int, int]]:
    """(stem_no, place, ply, fen, move, score, result) of a chunk's plies. Rows for which keep(ply, score, result) is false are passed
    over without a FEN; moves are played all the same."""
    for place, (n, board, move, score, result) in enumerate(_plies(payload)):
        if keep is None or keep(board.ply, score, result):
            yield n, place, board.ply, board.fen(), move, score, result


def _game_id(file_no: int, path: str, chunk_no: int, stem_no: int) -> int:
    if file_no == NO_FILE:
        return xxhash.xxh3_64_intdigest(f"{path}:{chunk_no}:{stem_no}") >> 1
    if file_no >= 1 << 63 - FILE_SHIFT or chunk_no >= 1 << FILE_SHIFT - CHUNK_SHIFT:
        raise ValueError("too many files, or chunks in a file, for one numbering of games")
    return file_no << FILE_SHIFT | chunk_no << CHUNK_SHIFT | stem_no


def _chunk_batches(file, file_no: int, path: str, chunk_no: int, offset: int, size: int, keep=None) -> Iterator[pa.RecordBatch]:
    file.seek(offset)
    rows = []
    for stem_no, place, ply, fen, move, score, result in chunk_rows(file.read(size), keep):
        rows.append((_game_id(file_no, path, chunk_no, stem_no), ply, fen, move, score, result, path, chunk_no, place))
        if len(rows) == 10_000:
            yield _table(rows)
            rows = []
    if rows:
        yield _table(rows)


def _decoded(index: DataFrame, keep: Callable[[int, int, int], bool] | None = None, partitions: int = 1, chunks_read=None) -> DataFrame:
    """Rows of SCHEMA of the chunks of an index, dealt over tasks; chunks_read, an accumulator, counts those that are read."""
    dealt = index.repartition(partitions, F.xxhash64("path", "chunk_no"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in sorted(batch.to_pylist(), key=lambda r: (r["path"], r["offset"])):
                fs, name = opened(r["path"])
                if chunks_read is not None:
                    chunks_read.add(1)
                with fs.open_input_file(name) as f:
                    yield from _chunk_batches(f, r["file_no"], r["path"], r["chunk_no"], r["offset"], r["size"], keep)

    return dealt.select("file_no", "path", "chunk_no", "offset", "size").mapInArrow(run, SCHEMA)


def read_binpack(spark: SparkSession, paths: str | list[str], partitions: int | None = None) -> DataFrame:
    """Rows of SCHEMA from chunk files: the index of chunks is dealt over tasks, and each reads and decodes its chunks' bytes. game_id
    is unique over all files read together. Write the result as Parquet before filtering it again and again; for filters of ply, score
    and result read with an index of statistics (read_indexed), or the data source (ChunkSource)."""
    files = _files(spark, paths)
    return _decoded(_index(files), partitions=partitions or _tasks(files))


STATISTICS = ("ply", "score", "result")


def chunk_statistics(spark: SparkSession, paths: str | list[str], partitions: int | None = None) -> DataFrame:
    """The index of chunks with n_rows and the least and largest ply, score and result of each: min_ply, max_ply and so on. Every chunk is
    decoded once, without FENs. Write it as Parquet beside the files: it is what read_indexed chooses chunks by."""
    files = _files(spark, paths)
    dealt = _index(files).repartition(partitions or _tasks(files), F.xxhash64("path", "chunk_no"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in sorted(batch.to_pylist(), key=lambda r: (r["path"], r["offset"])):
                fs, name = opened(r["path"])
                with fs.open_input_file(name) as f:
                    f.seek(r["offset"])
                    values = [(board.ply, score, result) for _, board, _, score, result in _plies(f.read(r["size"]))]
                r["n_rows"] = len(values)
                for i, c in enumerate(STATISTICS):
                    r[f"min_{c}"], r[f"max_{c}"] = (f(v[i] for v in values) if values else None for f in (min, max))
                rows.append(r)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    fields = [("file_no", pa.int32()), ("path", pa.string()), *((c, pa.int64()) for c in ("chunk_no", "offset", "size", "n_rows"))]
    schema = pa.schema(fields + [(f"{m}_{c}", pa.int32()) for c in STATISTICS for m in ("min", "max")])
    return dealt.mapInArrow(run, f"{INDEX}, n_rows long, " + ", ".join(f"{m}_{c} int" for c in STATISTICS for m in ("min", "max")))


def read_indexed(index: DataFrame, partitions: int | None = None, chunks_read=None, **bounds: tuple[int | None, int | None]) -> DataFrame:
    """Rows of SCHEMA whose ply, score and result lie within bounds, both ends included, None for no bound: read_indexed(index, ply=(20, None)).

    index is chunk_statistics, as stored. Chunks that can hold no such row are dropped by a filter of the index, before any file is
    opened; of the others, rows outside are passed over before their FEN is made. game_id is as read_binpack of the same files gives it.
    """
    if unknown := bounds.keys() - set(STATISTICS):
        raise ValueError(f"no statistics of {', '.join(sorted(unknown))}")
    index = index.where("n_rows > 0")
    for c, (low, high) in bounds.items():
        index = index if low is None else index.where(F.col(f"max_{c}") >= low)
        index = index if high is None else index.where(F.col(f"min_{c}") <= high)
    limits = [(STATISTICS.index(c), -1 << 31 if low is None else low, 1 << 31 if high is None else high) for c, (low, high) in bounds.items()]
    return _decoded(index, lambda *row: all(low <= row[i] <= high for i, low, high in limits), partitions or _tasks(index, "size"), chunks_read)


def stream_binpack(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of rows of SCHEMA from the chunk files that arrive in a folder, each file once, also over restarts from a checkpoint. Files
    must come whole, by a move. A trigger takes at most files_per_trigger files; their heads are walked and their chunks read by
    tasks, so a trigger's work is spread by chunks however large a file is. game_id is a 63-bit hash of path, chunk and stem, as
    arriving files have no number."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    files = files.option("maxFilesPerTrigger", files_per_trigger).load(folder).select(F.lit(NO_FILE).alias("file_no"), "path", "length")
    tasks = spark.sparkContext.defaultParallelism
    return _decoded(files.repartition(tasks, F.col("path")).mapInArrow(_heads, INDEX), partitions=tasks)


class ChunkRange(InputPartition):
    """The chunks of one file whose heads stand from lo to hi."""

    def __init__(self, file_no: int, path: str, length: int, lo: int, hi: int):
        self.file_no, self.path, self.length, self.lo, self.hi = file_no, path, length, lo, hi


class ChunkReader(DataSourceReader):
    """Partitions are ranges of bytes; each task walks heads up to its range's end. The driver lists files and opens none."""

    COMPARE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}
    PLACE = {"ply": 0, "score": 1, "result": 2}

    def __init__(self, path: str):
        self.path, self.pushed = path, []

    def partitions(self) -> list[ChunkRange]:
        fs, root = opened(self.path)
        found = fs.get_file_info(root)
        files = [found] if found.is_file else [i for i in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if i.is_file]
        out = []
        for no, info in enumerate(sorted(files, key=lambda i: i.path)):
            step = max(PARTITION_BYTES, -(-info.size // PARTITIONS_PER_FILE))
            out += [ChunkRange(no, info.path, info.size, lo, lo + step) for lo in range(0, info.size, step)]
        return out

    def read(self, partition: ChunkRange) -> Iterator[pa.RecordBatch]:
        tests = [(i, self.COMPARE[kind], value) for i, kind, value in self.pushed]
        keep = (lambda *row: all(test(row[i], value) for i, test, value in tests)) if tests else None
        fs, _ = opened(self.path)
        with fs.open_input_file(partition.path) as f:
            for n, offset, size in chunk_heads(f, partition.length):
                if offset - HEAD >= partition.hi:
                    break
                if offset - HEAD >= partition.lo:
                    yield from _chunk_batches(f, partition.file_no, partition.path, n, offset, size, keep)


class FilteringReader(ChunkReader):
    """Takes comparisons of ply, score and result with a number into the decoder, which passes over other rows before their FEN is made."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in self.COMPARE and len(f.attribute) == 1 and f.attribute[0] in self.PLACE and isinstance(f.value, int):
                self.pushed.append((self.PLACE[f.attribute[0]], type(f), f.value))
            else:
                yield f


class ChunkSource(DataSource):
    """spark.dataSource.register(ChunkSource); spark.read.format("binpack").load(path): rows of SCHEMA from a chunk file or a folder of
    them. With the option push = true, filters
    reach the decoder; Spark asks for spark.sql.python.filterPushdown.enabled then."""

    @classmethod
    def name(cls) -> str:
        return "binpack"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ChunkReader:
        kind = FilteringReader if self.options.get("push", "false").lower() == "true" else ChunkReader
        return kind(self.options["path"])
