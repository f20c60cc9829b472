"""Packed records written by a small encoder and read back."""

import pathlib
import random
import struct

import pytest
from pyspark.sql import functions as F

from rookery.plans import packing
from rookery.sources import binary
from rookery.sources.chess_rules import BLACK_LONG, BLACK_SHORT, WHITE_LONG, WHITE_SHORT, Board
from tests.test_core import FENS

RIGHTS = {"K": WHITE_SHORT, "Q": WHITE_LONG, "k": BLACK_SHORT, "q": BLACK_LONG}


def board(fen):
    field, side, rights, ep, rule50, full = fen.split()
    pieces, sq = [-1] * 64, 56
    for c in field:
        if c == "/":
            sq -= 16
        elif c.isdigit():
            sq += int(c)
        else:
            pieces[sq] = "PpNnBbRrQqKk".index(c)
            sq += 1
    s = "wb".index(side)
    return Board(pieces, s, sum(RIGHTS[c] for c in rights if c != "-"), "abcdefgh".index(ep[0]) + 8 * (int(ep[1]) - 1) if ep != "-" else -1, int(rule50), 2 * (int(full) - 1) + s)


def unsigned(v):
    return (-v - 1) * 2 + 1 if v < 0 else 2 * v


def fixed(b, move, score, ply, result):
    bits = []
    put = lambda v, n: bits.extend(v >> i & 1 for i in range(n))
    put(b.side, 1)
    put(b.pieces.index(10), 6)
    put(b.pieces.index(11), 6)
    for sq in (r * 8 + f for r in range(7, -1, -1) for f in range(8)):
        p = b.pieces[sq]
        if p < 0:
            put(0, 1)
        elif p < 10:
            put(1, 1)
            put(p // 2, 3)
            put(p % 2, 1)
    for r in (WHITE_SHORT, WHITE_LONG, BLACK_SHORT, BLACK_LONG):
        put(int(bool(b.rights & r)), 1)
    put(int(b.ep >= 0), 1)
    if b.ep >= 0:
        put(b.ep, 6)
    full = b.ply // 2 + 1
    put(b.rule50 & 63, 6)
    put(full & 255, 8)
    put(full >> 8, 8)
    put(b.rule50 >> 6, 1)
    raw = sum(x << i for i, x in enumerate(bits)).to_bytes(32, "little")
    f, t, kind, promo = move
    packed = ("normal", "promotion", "en_passant", "castle").index(kind) << 14 | (promo // 2 - 1 if promo >= 0 else 0) << 12 | f << 6 | t
    return raw + struct.pack("<hHHbB", score, packed, ply, result, 0)


def stem(b, move, score, result):
    occupied, nibbles = 0, []
    for sq, p in enumerate(b.pieces):
        if p < 0:
            continue
        occupied |= 1 << sq
        if b.ep >= 0 and p // 2 == 0 and sq == b.ep + (8 if b.ep // 8 == 2 else -8):
            p = 12
        elif (p, sq) in ((6, 0), (6, 7)) and b.rights & (WHITE_LONG if sq == 0 else WHITE_SHORT):
            p = 13
        elif (p, sq) in ((7, 56), (7, 63)) and b.rights & (BLACK_LONG if sq == 56 else BLACK_SHORT):
            p = 14
        elif p == 11 and b.side == 1:
            p = 15
        nibbles.append(p)
    nibbles += [0] * (32 - len(nibbles))
    f, t, kind, promo = move
    packed = ("normal", "promotion", "castle", "en_passant").index(kind) << 14 | f << 8 | t << 2 | (promo // 2 - 1 if promo >= 0 else 0)
    return occupied.to_bytes(8, "big") + bytes(nibbles[i] | nibbles[i + 1] << 4 for i in range(0, 32, 2)) + struct.pack(">HHHH", packed, unsigned(score), b.ply | unsigned(result) << 14, b.rule50)


def options(b):
    """(piece number, move number, number of moves, move) of all that can be coded."""
    for i, sq in enumerate(b.own()):
        kind = b.pieces[sq] // 2
        if kind == 0:
            to = b.pawn_moves(sq)
            if sq // 8 == (6 if b.side == 0 else 1):
                yield from ((i, 4 * k + j, 4 * len(to), (sq, t, "promotion", (1 + j) * 2 + b.side)) for k, t in enumerate(to) for j in range(4))
            else:
                yield from ((i, k, len(to), (sq, t, "en_passant" if t == b.ep else "normal", -1)) for k, t in enumerate(to))
            continue
        to, rooks = b.attacks(sq), b.castlings() if kind == 5 else []
        yield from ((i, k, len(to) + len(rooks), (sq, t, "normal", -1)) for k, t in enumerate(to))
        yield from ((i, len(to) + k, len(to) + len(rooks), (sq, t, "castle", -1)) for k, t in enumerate(rooks))


def safe(b, m):
    """Moves that leave both kings on the board and castle over empty squares only."""
    lo, hi = sorted(m[:2])
    return b.pieces[m[1]] // 2 != 5 and (m[2] != "castle" or all(b.pieces[q] < 0 for q in range(lo + 1, hi)))


def game(fen, plies, seed):
    """(bytes of a stem and its moves, expected rows)."""
    rng, b, result = random.Random(seed), board(fen), 1
    first = rng.choice([o for o in options(b) if safe(b, o[3])])[3]
    score, bits = rng.randint(-3000, 3000), []
    head, rows = stem(b, first, score, result), [(b.fen(), first, score, b.ply, result)]
    put = lambda v, n: bits.extend(v >> i & 1 for i in range(n - 1, -1, -1))
    move, done = first, 0
    for _ in range(plies):
        b.play(move)
        can = [o for o in options(b) if safe(b, o[3])]
        if not can:
            break
        special = [o for o in can if o[3][2] != "normal"]
        i, k, n, move = rng.choice(special or can)
        own = len(b.own())
        put(i, (own - 1).bit_length() if own > 1 else 0)
        put(k, (n - 1).bit_length() if n > 1 else 0)
        new = rng.randint(-3000, 3000)
        left = unsigned(new + score)
        while True:
            put((left & 15) | (16 if left >> 4 else 0), 5)
            left >>= 4
            if not left:
                break
        score, result, done = new, -result, done + 1
        rows.append((b.fen(), move, score, b.ply, result))
    bits += [0] * (-len(bits) % 8)
    body = bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8))
    return head + done.to_bytes(2, "big") + body, rows


def got(df):
    return [(r.fen, (r.move["from"], r.move["to"], r.move["type"], -1 if r.move["promo"] is None else r.move["promo"]), r.score, r.ply, r.result) for r in df.collect()]


def test_fixed_records(spark, tmp_path):
    moves = [(12, 28, "normal", -1), (60, 63, "castle", -1), (19, 28, "normal", -1), (54, 62, "promotion", 8)]
    want = [(board(f).fen(), m, 10 * i - 15, 40 + i, i % 3 - 1) for i, (f, m) in enumerate(zip(FENS, moves, strict=True))]
    (tmp_path / "a.bin").write_bytes(b"".join(fixed(board(f), m, s, p, r) for f, (_, m, s, p, r) in zip(FENS, want, strict=True)) * 50)
    assert [w[0] for w in want] == FENS
    assert sorted(got(binary.read_fixed_records(spark, str(tmp_path / "a.bin")))) == sorted(want * 50)


def test_chunks(spark, tmp_path):
    games = [game(f, 60, seed) for seed, f in enumerate([*FENS, "4k3/P6p/8/8/8/8/p6P/4K3 w - - 0 1", "r3k2r/8/8/8/8/8/8/R3K2R w KQkq - 0 9", "8/8/8/k7/1p6/8/2P5/K7 w - - 0 3"] * 3)]
    want = [r for _, rows in games for r in rows]
    assert {"castle", "promotion", "en_passant"} <= {r[1][2] for r in want}
    body = b"".join(g for g, _ in games[:10]), b"".join(g for g, _ in games[10:])
    (tmp_path / "a.binpack").write_bytes(b"".join(b"BINP" + len(x).to_bytes(4, "little") + x for x in body))
    index = binary.binpack_chunk_index(spark, str(tmp_path / "a.binpack")).orderBy("chunk_no").collect()
    assert [(r.chunk_no, r.offset, r.size) for r in index] == [(0, 8, len(body[0])), (1, 16 + len(body[0]), len(body[1]))]
    df = binary.read_binpack(spark, str(tmp_path / "a.binpack"), 3)
    assert got(df.orderBy("chunk_no", "pos_in_chunk")) == want
    assert df.select("game_id").distinct().count() == len(games)
    # two files with the same chunks: no game is numbered twice
    (tmp_path / "b.binpack").write_bytes((tmp_path / "a.binpack").read_bytes())
    both = binary.read_binpack(spark, [str(tmp_path / "a.binpack"), str(tmp_path / "b.binpack")])
    assert both.select("game_id").distinct().count() == 2 * len(games) and both.count() == 2 * len(want)
    spark.dataSource.register(binary.ChunkSource)
    source = spark.read.format("binpack").load(str(tmp_path / "a.binpack"))
    assert got(source.orderBy("chunk_no", "pos_in_chunk")) == want
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    some = spark.read.format("binpack").option("push", "true").load(str(tmp_path / "a.binpack")).where("ply > 20 AND score <= 100 AND fen LIKE '%w%'")
    assert sorted(got(some)) == sorted(r for r in want if r[3] > 20 and r[2] <= 100 and "w" in r[0])
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    (tmp_path / "bad.binpack").write_bytes(b"BINX" + bytes(9))
    with pytest.raises(Exception, match="no chunk begins"):
        binary.binpack_chunk_index(spark, str(tmp_path / "bad.binpack")).collect()


def chunk_file(path, seeds, plies=30):
    """One game a chunk; expected rows by chunk."""
    games = [game(FENS[k % len(FENS)], plies, k) for k in seeds]
    path.write_bytes(b"".join(b"BINP" + len(g).to_bytes(4, "little") + g for g, _ in games))
    return [rows for _, rows in games]


def test_statistics_leave_out_chunks(spark, tmp_path):
    chunks = chunk_file(tmp_path / "a.binpack", range(30))
    stats = binary.chunk_statistics(spark, str(tmp_path / "a.binpack"), 3)
    assert {(r.chunk_no, r.n_rows, r.min_score, r.max_score, r.min_ply, r.max_ply) for r in stats.collect()} == {
        (k, len(rows), min(r[2] for r in rows), max(r[2] for r in rows), rows[0][3], rows[-1][3]) for k, rows in enumerate(chunks)
    }
    stats.write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    inside = lambda r: r[3] >= 100 and r[2] <= 2000
    read = spark.sparkContext.accumulator(0)
    some = binary.read_indexed(index, 4, read, ply=(100, None), score=(None, 2000))
    assert sorted(got(some)) == sorted(r for rows in chunks for r in rows if inside(r)) and some.where("ply < 100").isEmpty()
    most = sum(max(r[3] for r in rows) >= 100 for rows in chunks)
    assert 0 < read.value <= 2 * most < 2 * len(chunks)
    assert got(binary.read_indexed(index).orderBy("chunk_no", "pos_in_chunk")) == [r for rows in chunks for r in rows]
    with pytest.raises(ValueError, match="no statistics"):
        binary.read_indexed(index, rule50=(0, 3))


def test_source_cuts_files_into_ranges_of_bytes(spark, tmp_path, monkeypatch):
    want = [r for name, seeds in (("a", range(20)), ("b", range(20, 33))) for rows in chunk_file(tmp_path / f"{name}.binpack", seeds) for r in rows]
    monkeypatch.setattr(binary, "PARTITION_BYTES", 300)
    reader = binary.ChunkReader(str(tmp_path))
    parts = reader.partitions()
    assert len(parts) > 8
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["fen"], r["score"], r["ply"], r["result"]) for r in rows] == [(r[0], *r[2:]) for r in want]
    monkeypatch.setattr(binary, "PARTITIONS_PER_FILE", 2)
    assert len(reader.partitions()) == 4


def test_chunk_files_as_a_stream(spark, tmp_path):
    """Files in two waves over a restart: every row once, games told apart."""
    (tmp_path / "in").mkdir()
    want = []
    for wave in (0, 1):
        for k in range(3):
            want += [r for rows in chunk_file(tmp_path / "in" / f"{wave}{k}.binpack", range(10 * k + wave, 10 * k + wave + 4), 12) for r in rows]
        rows = binary.stream_binpack(spark, str(tmp_path / "in"), 2)
        rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(got(out)) == sorted(want) and out.select("game_id").distinct().count() == 24
    (tmp_path / "bad.binpack").write_bytes((tmp_path / "in" / "00.binpack").read_bytes()[:40])
    with pytest.raises(Exception, match="claims"):
        binary.read_binpack(spark, str(tmp_path / "bad.binpack")).collect()


def test_first_example_of_the_readme(spark, tmp_path):
    """It runs as it stands, but for the paths, and every rule of the default settings takes part."""
    games = [game(f, 40, seed) for seed, f in enumerate(FENS * 5)]
    body = b"".join(g for g, _ in games)
    (tmp_path / "a.binpack").write_bytes(b"BINP" + len(body).to_bytes(4, "little") + body)
    readme = pathlib.Path(__file__).parent.parent / "README.md"
    code = readme.read_text().split("```python\n")[1].split("```")[0]
    names = {"spark": spark}
    exec(code.replace("games/*.binpack", f"{tmp_path}/*.binpack").replace('"records"', f'"{tmp_path}/records"'), names)  # noqa: S102
    kept, features = names["kept"], names["features"]
    assert 0 < kept.count() < sum(len(rows) for _, rows in games)
    assert features.select("row_id").distinct().count() == kept.count() and features.columns == ["row_id", "perspective", "feature"]
    from rookery.operators.filters import SkipConfig, apply_skip_config

    reasons = {r.reject_reason for r in apply_skip_config(spark.read.parquet(f"{tmp_path}/records"), SkipConfig(), key=["game_id", "ply"], audit=True).collect()}
    assert {"not_quiet", "result", "soft_early", "piece_count", None} <= reasons


def test_few_rows_of_an_index_are_many_tasks(spark, tmp_path):
    """An index is small, but its chunks aren't: Spark mustn't put its partitions together."""
    chunk_file(tmp_path / "a.binpack", range(24))
    tasks = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks(binary.read_binpack(spark, str(tmp_path))) > 3
    assert tasks(binary.chunk_statistics(spark, str(tmp_path))) > 3
    assert tasks(binary.read_indexed(binary.chunk_statistics(spark, str(tmp_path)))) > 3


def test_fixed_records_are_cut_into_ranges(spark, tmp_path, monkeypatch):
    record = packing.fixed_bytes("8/8/4k3/8/3P4/3K4/8/8 w - - 4 60", 19, 28, "normal", -7, 118, 1)
    (tmp_path / "a.bin").write_bytes(record * 25)
    monkeypatch.setattr(binary, "RANGE", 40 * 10)
    rows = binary.read_fixed_records(spark, str(tmp_path / "*.bin"))
    assert rows.count() == 25 and rows.distinct().count() == 1 and rows.first().score == -7
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    (tmp_path / "b.bin").write_bytes(record + record[:10])
    with pytest.raises(Exception, match="ends inside a record"):
        binary.read_fixed_records(spark, str(tmp_path / "*.bin")).count()
