"""Queries over positions and their features."""

from __future__ import annotations

from pyspark.sql import functions as F

from rookery.functions import board as B
from rookery.operators import features as X
from rookery.operators import filters
from rookery.operators.board_kernel import SLOTS
from rookery.plans.registry import query
from rookery.plans.sqltext import ATTACKS, BOARD, FREE

C = F.col


def parsed(v):
    return B.parse_fen(v("positions"))


@query("parse_fen", "positions", f"WITH {BOARD} SELECT event_id, array_to_string(board[1:8], ',') AS first_rank, white_to_move, CAST(len(list_filter(board, lambda p: p >= 0)) AS INT) AS piece_count, wk, bk, split_part(fen, ' ', 3) AS castling FROM kings")
def _(v):
    return parsed(v).select("event_id", F.array_join(F.slice("board", 1, 8).cast("array<string>"), ",").alias("first_rank"), "white_to_move", "piece_count", "wk", "bk", F.split_part("rest", F.lit(" "), F.lit(1)).alias("castling"))


@query("format_fen", "positions", "SELECT event_id, fen AS fen_out FROM positions")
def _(v):
    return B.format_fen(parsed(v)).select("event_id", "fen_out")


@query("piece_count", "positions", f"WITH {BOARD} SELECT event_id, CAST(len(list_filter(board, lambda p: p >= 0)) AS INT) AS n FROM boards")
def _(v):
    return parsed(v).select("event_id", B.piece_count(C("board")).alias("n"))


@query("bitboard", "positions", f"WITH {BOARD} SELECT event_id, hex(list_sum(list_transform(range(64), lambda q: CASE WHEN board[q + 1] >= 0 THEN 1::HUGEINT << q::HUGEINT ELSE 0::HUGEINT END))::UBIGINT) AS occupied, hex(list_sum(list_transform(range(64), lambda q: CASE WHEN board[q + 1] = 0 THEN 1::HUGEINT << q::HUGEINT ELSE 0::HUGEINT END))::UBIGINT) AS white_pawns FROM boards")
def _(v):
    return parsed(v).select("event_id", F.hex("occ").alias("occupied"), F.hex(B.bitboard(C("board"), lambda p: p == 0)).alias("white_pawns"))


@query("us_them", "positions", f"WITH {BOARD} SELECT event_id, CASE WHEN white_to_move THEN 1.0e0 ELSE 0.0e0 END AS us, CASE WHEN white_to_move THEN 0.0e0 ELSE 1.0e0 END AS them FROM boards")
def _(v):
    us, them = B.us_them(C("white_to_move"))
    return parsed(v).select("event_id", us.alias("us"), them.alias("them"))


MATERIAL = "(CASE WHEN white_to_move THEN 1 ELSE -1 END) * CAST(list_sum(list_transform(board, lambda p: CASE p // 2 WHEN 0 THEN 208 WHEN 1 THEN 781 WHEN 2 THEN 825 WHEN 3 THEN 1276 WHEN 4 THEN 2538 ELSE 0 END * CASE WHEN p < 0 THEN 0 WHEN p % 2 = 0 THEN 1 ELSE -1 END)) AS INT)"


@query("material_eval", "positions", f"WITH {BOARD} SELECT event_id, {MATERIAL} AS material FROM boards")
def _(v):
    return parsed(v).select("event_id", B.material_eval(C("board"), C("white_to_move")).alias("material"))


@query("drop_balanced_material", "positions", f"WITH {BOARD} SELECT event_id FROM boards WHERE abs({MATERIAL}) >= 150")
def _(v):
    p = parsed(v)
    return filters.drop_balanced_material(p, B.material_eval(C("board"), C("white_to_move")), 150).select("event_id")


CAPTURE = "(board[move_to + 1] >= 0 AND board[move_to + 1] % 2 <> board[move_from + 1] % 2)"


@query("is_capture", "positions", f"WITH {BOARD} SELECT event_id, {CAPTURE} AS capture FROM boards")
def _(v):
    return parsed(v).select("event_id", B.is_capture(C("board"), C("move_from"), C("move_to")).alias("capture"))


CHECKED = f"""{BOARD}, {ATTACKS}, once AS (SELECT DISTINCT fen_id, board, white_to_move, wk, bk FROM kings),
checked AS (SELECT DISTINCT fen_id FROM once JOIN attack a ON board[a.sq + 1] = a.piece AND (a.piece % 2 = 1) = white_to_move AND a.sq2 = CASE WHEN white_to_move THEN wk ELSE bk END WHERE {FREE})"""


@query("in_check", "positions", f"WITH {CHECKED} SELECT event_id FROM positions JOIN checked USING (fen_id)")
def _(v):
    return X.in_check(parsed(v), "event_id").select(C("row_id").alias("event_id"))


@query("keep_quiet", "positions", f"WITH {CHECKED} SELECT event_id FROM kings WHERE NOT {CAPTURE} AND fen_id NOT IN (SELECT fen_id FROM checked)")
def _(v):
    return X.keep_quiet(parsed(v), "move_from", "move_to").select("event_id")


@query("king_orientation", "positions", f"WITH {BOARD} SELECT event_id, CASE WHEN wk % 8 < 4 THEN 7 ELSE 0 END AS white_xor, xor(56, CASE WHEN bk % 8 < 4 THEN 7 ELSE 0 END) AS black_xor, CAST(4 * (7 - xor(wk, CASE WHEN wk % 8 < 4 THEN 7 ELSE 0 END) // 8) + 7 - xor(wk, CASE WHEN wk % 8 < 4 THEN 7 ELSE 0 END) % 8 AS INT) AS white_bucket FROM kings")
def _(v):
    return parsed(v).select("event_id", B.mirror_king_right(C("wk"), 0).alias("white_xor"), B.mirror_king_right(C("bk"), 1).alias("black_xor"), B.king_bucket(C("wk"), 0).alias("white_bucket"))


SIDES = "sides AS (SELECT k.*, persp, CASE WHEN persp = 0 THEN wk ELSE bk END AS ksq FROM kings k, (VALUES (0), (1)) s(persp))"
HALFKA = f"""{SIDES}, halfka AS (SELECT event_id AS row_id, persp AS perspective, CAST(xor(q, o) + xor(board[q + 1], persp) * 64 + 768 * (4 * (7 - xor(ksq, o) // 8) + 7 - xor(ksq, o) % 8) AS INT) AS feature
  FROM (SELECT *, xor(56 * persp, CASE WHEN ksq % 8 < 4 THEN 7 ELSE 0 END) AS o FROM sides), (SELECT CAST(r AS INT) AS q FROM range(64) t(r)) WHERE board[q + 1] >= 0)"""


@query("halfka_features", "positions", f"WITH {BOARD}, {HALFKA} SELECT * FROM halfka")
def _(v):
    return X.halfka_features(parsed(v), "event_id")


NUMBER = lambda q: f"(48 * xor(board[{q} + 1], persp) + xor({q}, o) - 8)"
PAWNS = f"""pawnpairs AS (SELECT event_id AS row_id, persp AS perspective, CAST(greatest(x, y) * (greatest(x, y) - 1) // 2 + least(x, y) AS INT) AS feature FROM
  (SELECT *, {NUMBER('a')} AS x, {NUMBER('b')} AS y FROM (SELECT *, xor(56 * persp, CASE WHEN ksq % 8 >= 4 THEN 7 ELSE 0 END) AS o FROM sides),
   (SELECT CAST(r AS INT) AS a FROM range(8, 56) t(r)), (SELECT CAST(r AS INT) AS b FROM range(8, 56) t(r)) WHERE b < a AND abs(a % 8 - b % 8) <= 1 AND board[a + 1] IN (0, 1) AND board[b + 1] IN (0, 1)))"""


@query("pawn_pair_features", "positions", f"WITH {BOARD}, {SIDES}, {PAWNS} SELECT * FROM pawnpairs")
def _(v):
    return X.pawn_pair_features(parsed(v), "event_id")


THREATS = f"""{ATTACKS}, slots(kind, other, slot) AS (SELECT * FROM (VALUES {', '.join(f'({a},{b},{s})' for a, line in enumerate(SLOTS) for b, s in enumerate(line) if s >= 0)}) t),
kinds(kind, n) AS (SELECT * FROM (VALUES (0,4),(1,10),(2,8),(3,8),(4,10)) t),
counts AS (SELECT piece, sq, count(*) AS n FROM attack WHERE piece < 10 GROUP BY 1, 2),
froms AS (SELECT q.piece, q.sq, CAST(coalesce(sum(c.n) OVER (PARTITION BY q.piece ORDER BY q.sq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS before FROM (SELECT CAST(p AS INT) AS piece, sq FROM range(10) t(p), sqs) q LEFT JOIN counts c ON c.piece = q.piece AND c.sq = q.sq),
totals AS (SELECT piece, CAST(sum(n) AS INT) AS total FROM counts GROUP BY 1),
firsts AS (SELECT t.piece, total, CAST(coalesce(sum(k.n * total) OVER (ORDER BY t.piece % 2, t.piece // 2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS first FROM totals t JOIN kinds k ON k.kind = t.piece // 2),
once AS (SELECT DISTINCT fen_id, board, persp, xor(56 * persp, CASE WHEN ksq % 8 >= 4 THEN 7 ELSE 0 END) AS o FROM sides),
hits AS (SELECT fen_id, persp, xor(a.piece, persp) AS p, xor(a.sq, o) AS f, xor(a.sq2, o) AS t, xor(board[a.sq2 + 1], persp) AS g FROM once JOIN attack a ON a.piece < 10 AND board[a.sq + 1] = a.piece WHERE board[a.sq2 + 1] BETWEEN 0 AND 9 AND {FREE}),
threats AS (SELECT fen_id, persp, CAST(s.first + ((g % 2) * (k.n // 2) + slot) * s.total + b.before + n.nth AS INT) AS feature
  FROM hits JOIN slots ON slots.kind = p // 2 AND slots.other = g // 2 JOIN kinds k ON k.kind = p // 2 JOIN firsts s ON s.piece = p JOIN froms b ON b.piece = p AND b.sq = f JOIN attack n ON n.piece = p AND n.sq = f AND n.sq2 = t
  WHERE NOT (p // 2 = g // 2 AND (p % 2 <> g % 2 OR p // 2 <> 0) AND f < t)),
threatrows AS (SELECT event_id AS row_id, persp AS perspective, feature FROM positions JOIN threats USING (fen_id))"""


@query("threat_features", "positions", f"WITH {BOARD}, {SIDES}, {THREATS} SELECT * FROM threatrows")
def _(v):
    return X.threat_features(parsed(v), "event_id")


ALL = f"WITH {BOARD}, {HALFKA}, {PAWNS}, {THREATS}, allrows AS (SELECT * FROM threatrows UNION ALL SELECT row_id, perspective, feature + 59808 FROM pawnpairs UNION ALL SELECT row_id, perspective, feature + 64368 FROM halfka)"


@query("compose_features", "positions", ALL + " SELECT row_id, perspective, count(*) AS n, CAST(sum(feature) AS BIGINT) AS total, min(feature) AS low, max(feature) AS high FROM allrows GROUP BY 1, 2")
def _(v):
    rows = X.compose_features(parsed(v), row_id="event_id").groupBy("row_id", "perspective")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("feature").alias("total"), F.min("feature").alias("low"), F.max("feature").alias("high"))


@query("pack_features", "positions", f"WITH {BOARD}, {HALFKA} SELECT row_id, perspective, array_to_string(list_concat(list_sort(list(feature)), list_transform(range(32 - count(*)), lambda x: -1::INT)), ',') AS features, CAST(count(*) AS INT) AS n_active FROM halfka GROUP BY 1, 2")
def _(v):
    return X.pack_features(parsed(v), "HalfKAv2_hm", "event_id").withColumn("features", F.array_join(C("features").cast("array<string>"), ","))


PACKED = f"""{ALL}, packed AS (SELECT row_id, perspective, array_to_string(list_concat(list_sort(list(feature)), list_transform(range(288 - count(*)), lambda x: -1::INT)), ',') AS features, CAST(count(*) AS INT) AS n_active FROM allrows GROUP BY 1, 2)"""


@query("pack_composed_features", "positions", PACKED + " SELECT row_id, perspective, md5(features) AS features_md5, n_active FROM packed")
def _(v):
    """All parts at once, told by the digest of the padded array."""
    packed = X.pack_features(parsed(v), row_id="event_id")
    return packed.select("row_id", "perspective", F.md5(F.array_join(C("features").cast("array<string>"), ",")).alias("features_md5"), "n_active")
