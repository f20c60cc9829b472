"""Where queries and their DuckDB counterparts are kept, and the views both read."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_SQUARES = "VALUES (0,'rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1',12,28), (1,'r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R b KQkq - 0 1',40,12), (2,'8/8/4k3/8/3P4/3K4/8/8 w - - 4 60',19,28), (3,'rnb1kbnr/pppp1ppp/8/4p3/6Pq/5P2/PPPPP2P/RNBQKBNR w KQkq - 1 3',8,16)"

#: Views over the tables; the text is the same for Spark and DuckDB unless two forms are given.
VIEWS: dict[str, str | tuple[str, str]] = {
    "evals": """SELECT event_id, user_id AS game_id, ply,
        CASE WHEN event_id % 29 = 0 THEN 32002 WHEN event_id % 7 = 0 THEN 0 ELSE CAST(floor(value * 10) AS INT) - 1500 END AS score,
        CAST((CASE WHEN ply % 2 = 0 THEN 1 ELSE -1 END) * (user_id % 3 - 1) AS INT) AS result,
        CAST(2 + event_id % 31 AS INT) AS piece_count, event_type AS source
        FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS ply FROM events) e""",
    "games": """SELECT o_orderkey AS game_no, o_orderdate AS played_at,
        CASE WHEN o_orderkey % 2 = 0 THEN net ELSE 'master' END AS white, CASE WHEN o_orderkey % 2 = 0 THEN 'master' ELSE net END AS black,
        CASE o_orderstatus WHEN 'F' THEN '1-0' WHEN 'O' THEN '0-1' ELSE '1/2-1/2' END AS result
        FROM (SELECT *, concat('run_', CAST(o_custkey % 4 AS STRING), '/nn-epoch', CAST(20 * (o_custkey % 10) + 19 AS STRING), '.nnue') AS net FROM orders) o""",
    "train_log": """SELECT CAST(l_suppkey % 4 AS INT) AS run_id, CAST(l_linenumber AS INT) AS epoch, l_orderkey AS step, l_shipdate AS ts,
        round(0.004e0 + l_extendedprice / 10000000.0e0, 6) AS train_loss, round(0.004e0 + l_quantity / 10000.0e0, 6) AS val_loss FROM lineitem""",
    "positions": f"SELECT e.event_id, f.fen_id, f.fen, f.move_from, f.move_to, e.score, e.ply, e.result FROM evals e JOIN (SELECT * FROM ({_SQUARES}) t(fen_id, fen, move_from, move_to)) f ON f.fen_id = e.event_id % 4",
    "acts": (
        "SELECT vec_id AS sample_id, p AS neuron, v <= 0 AS is_zero FROM embeddings LATERAL VIEW posexplode(embedding) t AS p, v",
        "SELECT sample_id, CAST(p AS INT) AS neuron, v <= 0 AS is_zero FROM (SELECT vec_id AS sample_id, unnest(range(64)) AS p, unnest(embedding) AS v FROM embeddings) e",
    ),
    "weights": (
        "SELECT vec_id AS feature, p AS out_idx, CAST(v AS DOUBLE) AS w FROM embeddings LATERAL VIEW posexplode(embedding) t AS p, v",
        "SELECT feature, CAST(p AS INT) AS out_idx, CAST(v AS DOUBLE) AS w FROM (SELECT vec_id AS feature, unnest(range(64)) AS p, unnest(embedding) AS v FROM embeddings) e",
    ),
    "sample_features": """SELECT event_id, slot, CASE WHEN event_id % 5 = 0 AND slot >= 6 THEN -1 ELSE CAST((event_id * 13 + slot * 71) % 200 AS INT) END AS feature
        FROM events CROSS JOIN (SELECT * FROM (VALUES (0),(1),(2),(3),(4),(5),(6),(7)) t(slot)) s""",
    "net_epochs": "SELECT DISTINCT CAST(o_custkey % 4 AS INT) AS run_id, CAST(20 * (o_custkey % 10) + 19 AS INT) AS epoch FROM orders",
    "artifacts": """SELECT concat('exp/run_', CAST(run_id AS STRING), '/nn-epoch', CAST(epoch AS STRING), '.nnue') AS path, CAST(1000 * run_id + epoch AS BIGINT) AS mtime, 'nnue' AS kind, run_id, epoch
        FROM net_epochs WHERE (run_id + epoch) % 7 <> 3
        UNION ALL SELECT concat('exp/run_', CAST(run_id AS STRING), '/epoch=', CAST(epoch AS STRING), '.ckpt'), CAST(1000 * run_id + epoch + 1 AS BIGINT), 'ckpt', run_id, epoch FROM net_epochs
        UNION ALL SELECT DISTINCT concat('exp/run_', CAST(run_id AS STRING), '/last.ckpt'), CAST(1000 * run_id + 500 AS BIGINT), 'ckpt', run_id, CAST(NULL AS INT) FROM net_epochs""",
}
NEEDS = {"positions": ["evals"], "artifacts": ["net_epochs"]}
TABLES = ("events", "orders", "lineitem", "embeddings")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of VIEWS over the Parquet tables of sf_dir. Tables go into the text as frames, so no view of the session is replaced."""
    text = VIEWS[name] if isinstance(VIEWS[name], str) else VIEWS[name][0]
    frames = {n: view(spark, sf_dir, n) for n in NEEDS.get(name, ())}
    frames |= {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f" {t}" in text}
    for n in frames:
        text = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", text)
    return spark.sql(text, **{n: f for n, f in frames.items() if f"{{{n}}}" in text})


def _with(names: list[str]) -> str:
    parts: dict[str, str] = {}
    for n in names:
        for x in [*NEEDS.get(n, ()), n]:
            parts.setdefault(x, VIEWS[x] if isinstance(VIEWS[x], str) else VIEWS[x][1])
    return "WITH " + ", ".join(f"{k} AS ({v.replace('AS STRING', 'AS VARCHAR')})" for k, v in parts.items())


def query(name: str, views: str = "", sql: str | None = None):
    """Register a function (spark, view, ...) under a name, with its DuckDB SQL over the named views.

    The function gets a loader of views; sql starts with the views as common table expressions, and may add its own first.
    """

    def put(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(lambda v: view(spark, sf_dir, v))
        if sql is not None:
            text = sql.strip()
            more = text[4:] if text.upper().startswith("WITH ") else None
            head = _with(views.split()) if views else ""
            ORACLES[name] = (head + ", " + more if more is not None else head + " " + text) if head else text
        return fn

    return put
