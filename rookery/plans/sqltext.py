"""Pieces of DuckDB SQL shared by the counterparts of queries."""

from __future__ import annotations


def u(key: str, salt: str) -> str:
    return f"(('0x' || substr(md5(concat(cast({key} AS VARCHAR), ':', {salt})),1,8))::BIGINT / 4294967296.0e0)"


def sig(x: str) -> str:
    return f"(CASE WHEN ({x}) >= 0 THEN 1 / (1 + exp(-({x}))) ELSE exp({x}) / (1 + exp({x})) END)"


def expected(v: str, offset: float, scaling: float) -> str:
    return f"(0.5e0 * (1 + {sig(f'(({v}) - {offset}e0) / {scaling}e0')} - {sig(f'(-({v}) - {offset}e0) / {scaling}e0')}))"


M = "(least(240, ply) / 64.0e0)"
A = f"(((-3.68389304e0 * {M} + 30.07065921e0) * {M} + -60.52878723e0) * {M} + 149.53378557e0)"
B = f"((((-2.0181857e0 * {M} + 15.85685038e0) * {M} + -29.83452023e0) * {M} + 47.59078827e0) * 1.5e0)"
X = "greatest(-2000.0e0, least(2000.0e0, score * 100.0e0 / 208.0e0))"
WIN, LOSS = sig(f"({X} - {A}) / {B}"), sig(f"(-{X} - {A}) / {B}")
RESULT_PROB = f"(CASE WHEN result > 0 THEN {WIN} WHEN result < 0 THEN {LOSS} ELSE 1 - {WIN} - {LOSS} END)"

SOFT = "(CASE WHEN ply <= 0 THEN 0.1e0 WHEN ply <= 6 THEN 0.1e0 + ply / 6.0e0 * 0.05e0 WHEN ply <= 10 THEN 0.15e0 + (ply - 6) / 4.0e0 * 0.1e0 WHEN ply <= 18 THEN 0.25e0 + (ply - 10) / 8.0e0 * 0.5e0 WHEN ply < 20 THEN 0.75e0 + (ply - 18) / 2.0e0 * 0.25e0 ELSE 1.0e0 END)"

REMAP = "(CASE WHEN abs(score) >= 31755 THEN sign(score) * (4000.0e0 + pow(0.85e0, greatest(0, 32000 - abs(score))) * 4000.0e0) ELSE score::DOUBLE END)"

TARGETS = """knots AS (SELECT * FROM (VALUES (0, 0.0e0, 0.4e0), (1, 0.4e0, 0.5e0), (2, 1.0e0, 0.3e0), (3, 1.0e0, -0.125e0), (4, 0.75e0, -0.25e0)) k(i, y, m)),
spline AS (SELECT CAST(p AS INT) AS piece_count, CASE WHEN p >= 32 THEN 0.75e0 ELSE greatest(0.0e0,
  (2*t*t*t - 3*t*t + 1) * a.y + (t*t*t - 2*t*t + t) * a.m + (3*t*t - 2*t*t*t) * b.y + (t*t*t - t*t) * b.m) END AS w
  FROM (SELECT p, least(p // 8, 3) AS i, p / 8.0e0 - least(p // 8, 3) AS t FROM range(33) r(p)) x JOIN knots a ON a.i = x.i JOIN knots b ON b.i = x.i + 1),
targets AS (SELECT piece_count, w, sum(w) OVER () AS total FROM spline)"""

BOARD = """boards AS (SELECT *, list_transform(range(64), lambda q: instr('PpNnBbRrQqKk', substr(flat, xor(q, 56) + 1, 1)) - 1) AS board, split_part(fen, ' ', 2) = 'w' AS white_to_move
  FROM (SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(replace(split_part(fen, ' ', 1), '/', ''), '8', '........'), '7', '.......'), '6', '......'), '5', '.....'), '4', '....'), '3', '...'), '2', '..'), '1', '.') AS flat FROM positions)),
kings AS (SELECT *, CAST(list_position(board, 10) - 1 AS INT) AS wk, CAST(list_position(board, 11) - 1 AS INT) AS bk FROM boards)"""

#: Attacks of all pieces on an empty board from geometry: (piece, sq, sq2, dist, step, nth).
ATTACKS = """sqs AS (SELECT CAST(r AS INT) AS sq FROM range(64) t(r)), pairs AS (SELECT a.sq AS sq, b.sq AS sq2, b.sq % 8 - a.sq % 8 AS dx, b.sq // 8 - a.sq // 8 AS dy FROM sqs a, sqs b WHERE a.sq <> b.sq),
attack AS (SELECT p.piece, sq, sq2, greatest(abs(dx), abs(dy)) AS dist, CASE WHEN kind IN (2,3,4) THEN sign(dy) * 8 + sign(dx) ELSE 0 END AS step,
  row_number() OVER (PARTITION BY p.piece, sq ORDER BY sq2) - 1 AS nth
  FROM pairs, (SELECT CAST(r AS INT) AS piece, CAST(r // 2 AS INT) AS kind FROM range(12) t(r)) p
  WHERE (kind = 0 AND abs(dx) = 1 AND dy = 1 - 2 * (piece % 2) AND sq BETWEEN 8 AND 55) OR (kind = 1 AND abs(dx) * abs(dy) = 2)
    OR (kind IN (2, 4) AND abs(dx) = abs(dy)) OR (kind IN (3, 4) AND dx * dy = 0) OR (kind = 5 AND greatest(abs(dx), abs(dy)) = 1))"""
FREE = "(step = 0 OR dist = 1 OR len(list_filter(range(1, dist::BIGINT), lambda k: board[CAST(sq + k * step + 1 AS INT)] >= 0)) = 0)"
