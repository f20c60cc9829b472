"""Queries that write a view to files, read them back with the library's readers and return what came back."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from rookery.functions.folders import shared_folder
from rookery.operators import batching
from rookery.plans import packing
from rookery.plans.registry import query
from rookery.plans.sqltext import u
from rookery.sources import binary, text

C = F.col


def written(v, writer, name: str) -> tuple:
    rows = v("positions").withColumn("file", F.floor(C("event_id") / 2000))
    root = shared_folder(rows.sparkSession, name)
    writer(rows, root, "file", "event_id")
    return rows.sparkSession, root


BACK = "ply, C_MOVE, score, result FROM positions".replace("C_MOVE", "move_from, move_to, 'normal' AS kind")


def decoded(spark, root: str):
    """The rows of the chunk files below root, decoded once into a table, as numbering reads them twice."""
    rows = binary.read_binpack(spark, f"{root}/*.binpack")
    rows.write.parquet(f"{root}/rows")
    return spark.read.schema(rows.schema).parquet(f"{root}/rows")


def moved(df, fen):
    return df.select(fen.alias("fen"), "ply", C("move.from").alias("move_from"), C("move.to").alias("move_to"), C("move.type").alias("kind"), "score", "result")


@query("read_fixed_records", "positions", f"SELECT fen, {BACK}")
def _(v):
    spark, root = written(v, packing.write_fixed_records, "fixed")
    return moved(binary.read_fixed_records(spark, f"{root}/*.bin"), C("fen"))


@query("binpack_chunk_index", "positions", """WITH r AS (SELECT event_id // 2000 AS file, (row_number() OVER (PARTITION BY event_id // 2000 ORDER BY event_id) - 1) // 256 AS chunk_no FROM positions)
SELECT CAST(file AS BIGINT) AS file, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(8 * (chunk_no + 1) + 34 * 256 * chunk_no AS BIGINT) AS "offset", CAST(34 * count(*) AS BIGINT) AS size FROM r GROUP BY 1, 2, file, r.chunk_no""")
def _(v):
    spark, root = written(v, packing.write_binpack, "chunks")
    index = binary.binpack_chunk_index(spark, f"{root}/*.binpack")
    return index.select(F.regexp_extract("path", r"(\d+)\.binpack$", 1).cast("bigint").alias("file"), "chunk_no", "offset", "size")


@query("read_binpack", "positions", f"""SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_no, array_to_string(string_split(fen, ' ')[1:5], ' ') AS fen, {BACK}""")
def _(v):
    """Rows in order of their games' numbers, which follow files, chunks and stems; the FEN's move counter comes from the ply and is left out."""
    spark, root = written(v, packing.write_binpack, "chunks")
    rows = decoded(spark, root)
    file = F.regexp_extract("path", r"(\d+)\.binpack$", 1).cast("bigint")
    numbered = batching.global_index(rows.withColumn("file", file), ["file", "chunk_no", "pos_in_chunk"], C("file"), "row_no")
    five = F.array_join(F.slice(F.split("fen", " "), 1, 5), " ")
    return numbered.select("row_no", five.alias("fen"), "ply", C("move.from").alias("move_from"), C("move.to").alias("move_to"), C("move.type").alias("kind"), "score", "result")


#: How the games of the view's four positions go on: (position, ply of the game, FEN but for its last field, move).
GAMES = (
    (0, 0, "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0", 12, 28, "normal"),
    (0, 1, "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq - 0", 52, 36, "normal"),
    (0, 2, "rnbqkbnr/pppp1ppp/8/4p3/4P3/8/PPPP1PPP/RNBQKBNR w KQkq - 0", 6, 21, "normal"),
    (0, 3, "rnbqkbnr/pppp1ppp/8/4p3/4P3/5N2/PPPP1PPP/RNBQKB1R b KQkq - 1", 57, 42, "normal"),
    (1, 0, "r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R b KQkq - 0", 40, 12, "normal"),
    (1, 1, "r3k2r/p1ppqpb1/1n2pnp1/3PN3/1p2P3/2N2Q1p/PPPBbPPP/R3K2R w KQkq - 0", 18, 12, "normal"),
    (1, 2, "r3k2r/p1ppqpb1/1n2pnp1/3PN3/1p2P3/5Q1p/PPPBNPPP/R3K2R b KQkq - 0", 60, 63, "castle"),
    (1, 3, "r4rk1/p1ppqpb1/1n2pnp1/3PN3/1p2P3/5Q1p/PPPBNPPP/R3K2R w KQ - 1", 4, 7, "castle"),
    (2, 0, "8/8/4k3/8/3P4/3K4/8/8 w - - 4", 19, 28, "normal"),
    (2, 1, "8/8/4k3/8/3PK3/8/8/8 b - - 5", 44, 43, "normal"),
    (2, 2, "8/8/3k4/8/3PK3/8/8/8 w - - 6", 27, 35, "normal"),
    (2, 3, "8/8/3k4/3P4/4K3/8/8/8 b - - 0", 43, 34, "normal"),
    (3, 0, "rnb1kbnr/pppp1ppp/8/4p3/6Pq/5P2/PPPPP2P/RNBQKBNR w KQkq - 1", 8, 16, "normal"),
    (3, 1, "rnb1kbnr/pppp1ppp/8/4p3/6Pq/P4P2/1PPPP2P/RNBQKBNR b KQkq - 0", 48, 40, "normal"),
    (3, 2, "rnb1kbnr/1ppp1ppp/p7/4p3/6Pq/P4P2/1PPPP2P/RNBQKBNR w KQkq - 0", 9, 25, "normal"),
    (3, 3, "rnb1kbnr/1ppp1ppp/p7/4p3/1P4Pq/P4P2/2PPP2P/RNBQKBNR b KQkq - 0", 50, 34, "normal"),
)
PLIES = f"""lines(fen_id, k, fen5, move_from, move_to, kind) AS (VALUES {", ".join(map(str, GAMES))}),
plies AS (SELECT p.event_id, l.k, l.fen5 AS fen, CAST(p.ply + l.k AS INT) AS ply, CAST(l.move_from AS INT) AS move_from, CAST(l.move_to AS INT) AS move_to, l.kind,
  CAST(CASE WHEN l.k = 0 THEN p.score ELSE (p.event_id * (l.k + 3)) % 2001 - 1000 END AS INT) AS score, CAST(p.result * (CASE WHEN l.k % 2 = 0 THEN 1 ELSE -1 END) AS INT) AS result
  FROM positions p JOIN lines l ON l.fen_id = p.fen_id AND l.k <= (p.event_id // 4) % 4)"""


def written_games(v, name: str, file=None) -> tuple:
    """The view's positions as games of one to four plies, in files of 2000 unless another column deals them."""
    line = lambda i: F.array(*[F.struct(F.lit(f).alias("from"), F.lit(t).alias("to"), F.lit(kind).alias("type"), ((C("event_id") * (k + 3)) % 2001 - 1000).cast("int").alias("score")) for fen_id, k, _, f, t, kind in GAMES if fen_id == i and k])
    lines = F.when(C("fen_id") == 0, line(0)).when(C("fen_id") == 1, line(1)).when(C("fen_id") == 2, line(2)).otherwise(line(3))
    rows = v("positions").withColumn("line", F.slice(lines, F.lit(1), (F.floor(C("event_id") / 4) % 4).cast("int")))
    rows = rows.withColumn("file", F.floor(C("event_id") / 2000) if file is None else file)
    root = shared_folder(rows.sparkSession, name)
    packing.write_games(rows, root, "file", "event_id")
    return rows.sparkSession, root


def five():
    """A FEN without its last field, the move counter."""
    return F.array_join(F.slice(F.split("fen", " "), 1, 5), " ")


@query("read_binpack_games", "positions", f"WITH {PLIES} SELECT row_number() OVER (ORDER BY event_id, k) - 1 AS row_no, fen, ply, move_from, move_to, kind, score, result FROM plies")
def _(v):
    """Games with move lists, castlings among them, in order."""
    spark, root = written_games(v, "games")
    rows = decoded(spark, root)
    file = F.regexp_extract("path", r"(\d+)\.binpack$", 1).cast("bigint")
    numbered = batching.global_index(rows.withColumn("file", file), ["file", "chunk_no", "pos_in_chunk"], C("file"), "row_no")
    return numbered.select("row_no", five().alias("fen"), "ply", C("move.from").alias("move_from"), C("move.to").alias("move_to"), C("move.type").alias("kind"), "score", "result")


@query("chunk_statistics", "positions", f"""WITH {PLIES}, n AS (SELECT event_id, (row_number() OVER (PARTITION BY event_id // 2000 ORDER BY event_id) - 1) // 256 AS chunk_no FROM positions)
SELECT CAST(event_id // 2000 AS BIGINT) AS file, CAST(chunk_no AS BIGINT) AS chunk_no, count(*) AS n_rows, min(ply) AS min_ply, max(ply) AS max_ply, min(score) AS min_score, max(score) AS max_score, min(result) AS min_result, max(result) AS max_result
FROM plies JOIN n USING (event_id) GROUP BY 1, 2, event_id // 2000, chunk_no""")
def _(v):
    spark, root = written_games(v, "games")
    found = binary.chunk_statistics(spark, f"{root}/*.binpack")
    return found.select(F.regexp_extract("path", r"(\d+)\.binpack$", 1).cast("bigint").alias("file"), "chunk_no", "n_rows", *[f"{m}_{c}" for c in binary.STATISTICS for m in ("min", "max")])


@query("read_indexed", "positions", f"WITH {PLIES} SELECT fen, ply, move_from, move_to, kind, score, result FROM plies WHERE ply BETWEEN 10 AND 30 AND score >= 200")
def _(v):
    """Files by ply, their statistics as a table, and a read by bounds that leaves out the chunks beyond them. A file has the rows of at most
    20 000 events, so files grow in number, not in length."""
    spark, root = written_games(v, "games", F.concat_ws("-", F.floor(C("ply") / 8), F.floor(C("event_id") / 20_000)))
    binary.chunk_statistics(spark, f"{root}/*.binpack").write.parquet(f"{root}/index")
    rows = binary.read_indexed(spark.read.parquet(f"{root}/index"), ply=(10, 30), score=(200, None))
    return rows.select(five().alias("fen"), "ply", C("move.from").alias("move_from"), C("move.to").alias("move_to"), C("move.type").alias("kind"), "score", "result")


@query("read_metrics", "train_log", """WITH one AS (SELECT run_id, epoch, step, min(train_loss) AS train_loss, min(val_loss) AS val_loss FROM train_log GROUP BY 1, 2, 3)
SELECT run_id, epoch, step, 'train_loss' AS name, train_loss AS value FROM one UNION ALL SELECT run_id, epoch, step, 'val_loss', val_loss FROM one WHERE run_id >= 2""")
def _(v):
    """Runs 0 and 1 log one metric, 2 and 3 two: their files have different heads."""
    log = v("train_log").groupBy("run_id", "epoch", "step").agg(F.min("train_loss").alias("train_loss"), F.min("val_loss").alias("val_loss"))
    spark = log.sparkSession
    root = shared_folder(spark, "metrics")
    log.where("run_id < 2").drop("val_loss").write.partitionBy("run_id").option("header", True).csv(f"{root}/a")
    log.where("run_id >= 2").write.partitionBy("run_id").option("header", True).csv(f"{root}/b")
    long = text.read_metrics(spark, [f"{root}/a/*/*.csv", f"{root}/b/*/*.csv"])
    return long.select(F.regexp_extract("path", r"run_id=(\d+)", 1).cast("int").alias("run_id"), "epoch", "step", "name", "value")


@query("scan_artifacts", "artifacts", "SELECT path, kind, run_id, epoch FROM artifacts")
def _(v):
    """Every artefact as a small file below a folder, found again by name."""
    found = v("artifacts")
    spark = found.sparkSession
    root = shared_folder(spark, "artifacts")

    def touch(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, base = binary.opened(root)
                fs.create_dir(f"{base}/{path.rpartition('/')[0]}", recursive=True)
                with fs.open_output_stream(f"{base}/{path}") as out:
                    out.write(b"x")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    found.select("path").mapInArrow(touch, "n long").collect()  # a count per batch
    back = text.scan_artifacts(spark, root)
    return back.select(F.substring_index("path", root + "/", -1).alias("path"), "kind", "run_id", "epoch")


ORDERED = f"o AS (SELECT event_id, ply, score, CAST((event_id // 100) % 3 AS INT) AS shard, {u('event_id', chr(39) + 'shuffle0' + chr(39))} AS x FROM evals)"


@query("write_training_shards", "evals", f"WITH {ORDERED} SELECT event_id, ply, score, shard, row_number() OVER (PARTITION BY shard ORDER BY x, event_id) - 1 AS row_no FROM o")
def _(v):
    """Shards of shuffled rows, each read back in its order."""
    rows = batching.assign_shard(v("evals").select("event_id", "ply", "score", F.floor(C("event_id") / 100).alias("chunk_no")), 3)
    spark, root = rows.sparkSession, shared_folder(rows.sparkSession, "shards")
    batching.write_training_shards(batching.shuffle_rows(rows.drop("chunk_no"), "event_id"), root, ["shuffle_key", "event_id"], file_rows=1000)
    back = [batching.read_shard(spark, root, k).select("event_id", "ply", "score", F.lit(k).alias("shard"), "row_no") for k in range(3)]
    return back[0].unionByName(back[1]).unionByName(back[2])


@query("append_games", "games", "SELECT game_no, white, black, result, CAST(game_no % 3 AS INT) AS round_id FROM games")
def _(v):
    """Three rounds, each appended twice: the second call adds nothing."""
    games = v("games").select("game_no", "white", "black", "result")
    root = shared_folder(games.sparkSession, "games")
    for k in (0, 1, 2, 1, 0):
        text.append_games(games.where(C("game_no") % 3 == k), root, k)
    return games.sparkSession.read.parquet(root).select("game_no", "white", "black", "result", "round_id")
