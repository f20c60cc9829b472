"""Writers of packed records from views, so that queries can read them back: the counterparts of the readers in sources/binary.py."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.functions.board import LETTERS
from rookery.sources.binary import FIXED_TYPES, MAGIC, PACKED_TYPES, opened
from rookery.sources.chess_rules import BLACK_LONG, BLACK_SHORT, WHITE_LONG, WHITE_SHORT, Board

RIGHTS = "KQkq"


@lru_cache(1 << 14)
def fen_parts(fen: str) -> tuple[list[int], int, str, int, int, int]:
    """(piece ids by square, side, rights, en-passant square or -1, halfmove clock, full moves). Positions that recur are remembered; the list isn't to be changed."""
    field, side, rights, ep, clock, full = fen.split()
    pieces = [-1] * 64
    for rank, row in enumerate(field.split("/")):
        file = 0
        for c in row:
            if c.isdigit():
                file += int(c)
            else:
                pieces[(7 - rank) * 8 + file] = LETTERS.index(c)
                file += 1
    return pieces, int(side == "b"), rights, "abcdefgh".index(ep[0]) + 8 * (int(ep[1]) - 1) if ep != "-" else -1, int(clock), int(full)


class _Bits:
    """Numbers put one after the other, each from its lowest bit on."""

    def __init__(self):
        self.value = self.used = 0

    def put(self, number: int, width: int) -> None:
        self.value |= number << self.used
        self.used += width


def fixed_bytes(fen: str, move_from: int, move_to: int, kind: str, score: int, ply: int, result: int, promo: int = -1) -> bytes:
    """A 40-byte record."""
    pieces, side, rights, ep, clock, full = fen_parts(fen)
    bits = _Bits()
    bits.put(side, 1)
    for king in (10, 11):
        bits.put(pieces.index(king), 6)
    for sq in (r * 8 + f for r in range(7, -1, -1) for f in range(8)):
        if pieces[sq] < 0:
            bits.put(0, 1)
        elif pieces[sq] < 10:
            bits.put(1 | pieces[sq] // 2 << 1 | pieces[sq] % 2 << 4, 5)
    for r in RIGHTS:
        bits.put(int(r in rights), 1)
    bits.put(int(ep >= 0), 1)
    if ep >= 0:
        bits.put(ep, 6)
    for number, width in ((clock & 63, 6), (full & 255, 8), (full >> 8, 8), (clock >> 6, 1)):
        bits.put(number, width)
    packed = FIXED_TYPES.index(kind) << 14 | (promo // 2 - 1 if promo >= 0 else 0) << 12 | move_from << 6 | move_to
    return bits.value.to_bytes(32, "little") + struct.pack("<hHHbB", score, packed, ply, result, 0)


def _unsigned(v: int) -> int:
    return 2 * -v - 1 if v < 0 else 2 * v


@lru_cache(1 << 14)
def _stem_board(fen: str) -> bytes:
    """The 24 bytes of a stem that hold the board."""
    pieces, side, rights, ep, *_ = fen_parts(fen)
    rooks = {7: "K", 0: "Q", 63: "k", 56: "q"}
    occupied, nibbles = 0, []
    for sq, p in enumerate(pieces):
        if p < 0:
            continue
        occupied |= 1 << sq
        pushed = ep >= 0 and p // 2 == 0 and sq == (ep + 8 if ep // 8 == 2 else ep - 8)
        if pushed:
            p = 12
        elif p in (6, 7) and rooks.get(sq, "-") in rights and p == 6 + (sq >= 56) and sq in rooks:
            p = 13 + (sq >= 56)
        elif p == 11 and side:
            p = 15
        nibbles.append(p)
    nibbles += [0] * (32 - len(nibbles))
    return occupied.to_bytes(8, "big") + bytes(a | b << 4 for a, b in zip(nibbles[::2], nibbles[1::2], strict=True))


def stem_bytes(fen: str, move_from: int, move_to: int, kind: str, score: int, ply: int, result: int, promo: int = -1) -> bytes:
    """A stem without further plies: 34 bytes."""
    packed = PACKED_TYPES.index(kind) << 14 | move_from << 8 | move_to << 2 | (promo // 2 - 1 if promo >= 0 else 0)
    return _stem_board(fen) + struct.pack(">HHHHH", packed, _unsigned(score), ply | _unsigned(result) << 14, fen_parts(fen)[4], 0)


@lru_cache(1 << 14)
def _choices(fen: str, moves: tuple[tuple[int, int, str], ...]) -> list[tuple[int, int]]:
    """For each move after the first its number among the position's, as one number and its bits: the piece, then the target."""
    pieces, side, rights, ep, clock, _ = fen_parts(fen)
    bit = dict(zip(RIGHTS, (WHITE_SHORT, WHITE_LONG, BLACK_SHORT, BLACK_LONG), strict=True))
    board, out = Board(list(pieces), side, sum(bit.get(r, 0) for r in rights), ep, clock, 0), []
    for before, (frm, to, kind) in zip(moves, moves[1:], strict=False):
        board.play((*before, -1))
        own = board.own()
        pawn = pieces_kind(board, frm) == 0
        targets = board.pawn_moves(frm) if pawn else board.attacks(frm)
        castles = board.castlings() if pieces_kind(board, frm) == 5 else []
        n = len(targets) + len(castles)
        bits = (n - 1).bit_length()
        chosen = len(targets) + castles.index(to) if kind == "castle" else targets.index(to)
        out.append((own.index(frm) << bits | chosen, (len(own) - 1).bit_length() + bits))
    return out


def game_bytes(stem: dict, line: list[tuple[int, int, str, int]]) -> bytes:
    """A game: its stem and the further plies of line, (from, to, type, score) each."""
    head = stem_bytes(stem["fen"], stem["move_from"], stem["move_to"], "normal", stem["score"], stem["ply"], stem["result"])
    out, width = 0, 0

    def put(number: int, bits: int) -> None:
        nonlocal out, width
        out, width = out << bits | number, width + bits

    score = stem["score"]
    choices = _choices(stem["fen"], ((stem["move_from"], stem["move_to"], "normal"), *((frm, to, kind) for frm, to, kind, _ in line)))
    for choice, (*_, new) in zip(choices, line, strict=True):
        put(*choice)
        left = _unsigned((new + score + 0x8000 & 0xFFFF) - 0x8000)
        while True:
            put(left & 15 | (left > 15) << 4, 5)
            left >>= 4
            if not left:
                break
        score = new
    body = (out << -width % 8).to_bytes(-(-width // 8), "big")
    return head[:-2] + len(line).to_bytes(2, "big") + body


def pieces_kind(board: Board, sq: int) -> int:
    return board.pieces[sq] // 2


def _write_files(df: DataFrame, path: str, file: str, order: str, suffix: str, body, more: tuple[str, ...] = ()) -> int:
    """A file per value of `file`, written by one task under a name of its own attempt and then renamed: (number of files)."""
    need = ["fen", "move_from", "move_to", "score", "ply", "result", *more]

    def run(group: pa.Table) -> pa.Table:
        import uuid

        rows = group.sort_by(order).to_pylist()
        fs, root = opened(path)
        fs.create_dir(root, recursive=True)
        name, own = f"{root}/{rows[0]['file']}{suffix}", f"{root}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(own) as out:
            for part in body(rows):
                out.write(part)
        fs.move(own, name)
        return pa.table({"name": [name]})

    asked = df.select(F.col(file).alias("file"), F.col(order).alias(order), *need)
    return asked.groupBy("file").applyInArrow(run, "name string").count()


def write_fixed_records(df: DataFrame, path: str, file: str, order: str) -> int:
    """Rows (fen, move_from, move_to, score, ply, result) as 40-byte records, a `.bin` file per value of `file`, by order. A file's rows meet in one task."""

    def body(rows: list[dict]) -> Iterator[bytes]:
        for r in rows:
            yield fixed_bytes(r["fen"], r["move_from"], r["move_to"], "normal", r["score"], r["ply"], r["result"])

    return _write_files(df, path, file, order, ".bin", body)


def write_binpack(df: DataFrame, path: str, file: str, order: str, chunk_rows: int = 256) -> int:
    """The same rows as chunks of chunk_rows stems, a `.binpack` file per value of `file`."""

    def body(rows: list[dict]) -> Iterator[bytes]:
        for lo in range(0, len(rows), chunk_rows):
            stems = b"".join(stem_bytes(r["fen"], r["move_from"], r["move_to"], "normal", r["score"], r["ply"], r["result"]) for r in rows[lo : lo + chunk_rows])
            yield MAGIC + len(stems).to_bytes(4, "little") + stems

    return _write_files(df, path, file, order, ".binpack", body)


def write_games(df: DataFrame, path: str, file: str, order: str, chunk_games: int = 256) -> int:
    """Rows with a column `line`, an array of further plies (from, to, type, score), as chunks of chunk_games games."""

    def body(rows: list[dict]) -> Iterator[bytes]:
        for lo in range(0, len(rows), chunk_games):
            games = b"".join(game_bytes(r, [(m["from"], m["to"], m["type"], m["score"]) for m in r["line"]]) for r in rows[lo : lo + chunk_games])
            yield MAGIC + len(games).to_bytes(4, "little") + games

    return _write_files(df, path, file, order, ".binpack", body, ("line",))
