"""Queries that run a stream over files to its end and return what it left, with the batch form's SQL beside them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rookery.functions.folders import shared_folder
from rookery.operators.filters import SkipConfig
from rookery.plans import packing
from rookery.plans.experiments import ONE, STANDINGS, one_per_step, r6
from rookery.plans.positions import PACKED
from rookery.plans.records import PLACE, RESULT_PROB, SOFT
from rookery.plans.registry import query
from rookery.plans.sqltext import TARGETS, u
from rookery.sources.binary import stream_binpack
from rookery.streaming import streams

C = F.col
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A file lands with about this many rows; a wave of files brings a key about this many at most, as a task holds a key's rows.
FILE_ROWS, WAVE_ROWS = 250_000, 1_000_000
#: Triggers in which files that wait are taken, where an operator holds no rows of a trigger in memory.
TRIGGERS = 8


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """The state store that operators with state need, for as long as the streams run; the session's own setting comes back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def landed(df: DataFrame, name: str, least: int = 4) -> tuple[DataFrame, str]:
    """df written as files, `least` at least, and a stream that reads them in TRIGGERS triggers, or two at a time where there are few."""
    spark = df.sparkSession
    root = shared_folder(spark, name)
    files = max(least, -(-df.count() // FILE_ROWS))
    df.repartition(files).write.parquet(f"{root}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", per_trigger(files, 2)).parquet(f"{root}/in"), root


def per_trigger(files: int, least: int) -> int:
    """Files a trigger. Every trigger costs the same jobs, commits and reports of tasks, so their number doesn't grow with the input."""
    return max(least, -(-files // TRIGGERS))


def put_to(stream: DataFrame, root: str, mode: str = "append"):
    """A query that sends a stream to Parquet until its input is done."""
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/cp").trigger(availableNow=True)
    if mode == "append":
        return out.format("parquet").option("path", f"{root}/out").start()
    put = lambda batch, i: batch.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{root}/out")
    return out.foreachBatch(put).start()


def in_waves(df: DataFrame, name: str, key: str, position: Column, operator: Callable[[DataFrame], DataFrame], mode: str = "append", least: int = 3) -> DataFrame:
    """What a stream with state leaves when its files arrive in waves, in order of `position`: after each wave the query is started
    again from its checkpoint and takes the wave in one trigger, so state goes from trigger to trigger and from start to start. df is worked
    out once, into a table by wave; there are as many waves as the key of most rows needs."""
    spark = df.sparkSession
    root = shared_folder(spark, name)
    df.withColumn("__at", position).write.parquet(f"{root}/rows")
    rows = spark.read.parquet(f"{root}/rows")
    held = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("low"), F.max("__at").alias("high"))
    n, low, high = held.agg(F.max("n"), F.min("low"), F.max("high")).first()
    n, low, high = (n, low, high) if n else (0, 0, 0)
    waves = max(least, -(-n // WAVE_ROWS))
    wave = F.least(F.floor((F.col("__at") - F.lit(low)) * waves / (high - low + 1)), F.lit(waves - 1))
    rows.withColumn("__wave", wave.cast("int")).drop("__at").write.partitionBy("__wave").parquet(f"{root}/waves")
    dealt = spark.read.schema(T.StructType([*df.schema, T.StructField("__wave", T.IntegerType())])).parquet(f"{root}/waves")
    with rocks_state(spark):
        for i in range(waves):
            dealt.where(F.col("__wave") == i).select(*df.columns).write.mode("append").parquet(f"{root}/in")
            put_to(operator(spark.readStream.schema(df.schema).parquet(f"{root}/in")), root, mode).awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query("stream_training_rows", "positions", f"""{PACKED}, chosen AS (SELECT event_id, CASE WHEN split_part(fen, ' ', 2) = 'w' THEN 1.0e0 ELSE 0.0e0 END AS us, score FROM positions WHERE score <> 32002 AND NOT {u('event_id', chr(39) + 'random' + chr(39))} < 0.5e0
  AND {u('event_id', chr(39) + 'result' + chr(39))} < {RESULT_PROB} AND NOT (ply < 20 AND {u('event_id', chr(39) + 'soft' + chr(39))} >= {SOFT}))
SELECT event_id, us, score, md5(w.features) AS white_md5, md5(b.features) AS black_md5 FROM chosen JOIN packed w ON w.row_id = event_id AND w.perspective = 0 JOIN packed b ON b.row_id = event_id AND b.perspective = 1""")
def _(v):
    """Whole feature arrays, told by their digests."""
    p = v("positions")
    root = shared_folder(p.sparkSession, "rows")
    p.repartition(max(4, -(-p.count() // FILE_ROWS))).write.parquet(f"{root}/in")
    cfg = SkipConfig(quiet=False, thin_random=1)
    streams.stream_training_rows(p.sparkSession, f"{root}/in", p.schema, f"{root}/out", f"{root}/cp", cfg, "event_id", 2).awaitTermination()
    digest = lambda c: F.md5(F.array_join(C(c).cast("array<string>"), ",")).alias(f"{c}_md5")
    return p.sparkSession.read.parquet(f"{root}/out").select("event_id", "us", "score", digest("white"), digest("black"))


@query("stream_chunk_files", "positions", f"""{PACKED}, n AS (SELECT event_id, (row_number() OVER (PARTITION BY event_id // 2000 ORDER BY event_id) - 1) AS place FROM positions),
keyed AS (SELECT p.*, concat_ws('/', event_id // 2000, place // 256, place % 256) AS row_id FROM positions p JOIN n USING (event_id)),
chosen AS (SELECT event_id, row_id, CASE WHEN split_part(fen, ' ', 2) = 'w' THEN 1.0e0 ELSE 0.0e0 END AS us, score FROM keyed WHERE score <> 32002 AND NOT {u('row_id', chr(39) + 'random' + chr(39))} < 0.5e0
  AND {u('row_id', chr(39) + 'result' + chr(39))} < {RESULT_PROB} AND NOT (ply < 20 AND {u('row_id', chr(39) + 'soft' + chr(39))} >= {SOFT}))
SELECT c.row_id, us, score, md5(w.features) AS white_md5, md5(b.features) AS black_md5 FROM chosen c JOIN packed w ON w.row_id = event_id AND w.perspective = 0 JOIN packed b ON b.row_id = event_id AND b.perspective = 1""")
def _(v):
    """Chunk files arrive in two waves; the query is started again from its checkpoint for the second, and takes a wave in TRIGGERS triggers, or one file a trigger."""
    p = v("positions").withColumn("file", F.floor(C("event_id") / 2000))
    spark, root = p.sparkSession, shared_folder(p.sparkSession, "chunks")
    file = F.regexp_extract("path", r"(\d+)\.binpack$", 1)
    for wave in (0, 1):
        files = packing.write_binpack(p.where(C("file") % 2 == wave), f"{root}/in", "file", "event_id")
        records = stream_binpack(spark, f"{root}/in", per_trigger(files, 1)).withColumn("row_id", F.concat_ws("/", file, "chunk_no", "pos_in_chunk"))
        streams.write_training_rows(records, f"{root}/out", f"{root}/cp", SkipConfig(quiet=False, thin_random=1), "row_id").awaitTermination()
    digest = lambda c: F.md5(F.array_join(C(c).cast("array<string>"), ",")).alias(f"{c}_md5")
    return spark.read.parquet(f"{root}/out").select("row_id", "us", "score", digest("white"), digest("black"))


@query("stream_standings", "games", f"WITH {STANDINGS} SELECT player, wins, draws, losses, round(elo, 6) AS elo, place FROM standings")
def _(v):
    stream, root = landed(v("games"), "standings")
    streams.stream_standings(stream, f"{root}/out", f"{root}/cp").awaitTermination()
    return stream.sparkSession.read.parquet(f"{root}/out").select("player", "wins", "draws", "losses", *r6("elo"), "place")


@query("stream_decayed_average", "train_log", f"WITH {ONE}, k AS (SELECT *, count(*) OVER (PARTITION BY run_id) - row_number() OVER (PARTITION BY run_id ORDER BY step) AS d, count(*) OVER (PARTITION BY run_id) AS n FROM one) SELECT run_id, any_value(n) AS n, round(sum(train_loss * pow(0.995e0, d)) / sum(pow(0.995e0, d)), 6) AS average FROM k GROUP BY 1")
def _(v):
    """The log grows in waves of steps; the row of most values of each run is its average."""
    rows = one_per_step(v).withColumnRenamed("train_loss", "value")
    out = in_waves(rows, "average", "run_id", C("step"), streams.stream_decayed_average, "update")
    return out.groupBy("run_id").agg(F.max_by(F.struct("n", "average"), "n").alias("a")).select("run_id", "a.n", F.round("a.average", 6).alias("average"))


@query("stream_nan_alarm", "train_log", "SELECT DISTINCT run_id FROM train_log WHERE step % 97 = 0")
def _(v):
    spoiled = v("train_log").select("run_id", "step", F.when(C("step") % 97 == 0, float("nan")).otherwise(C("train_loss")).alias("loss"))
    stream, root = landed(spoiled, "alarm")
    put_to(streams.stream_nan_alarm(stream), root).awaitTermination()
    return stream.sparkSession.read.parquet(f"{root}/out").select("run_id")


@query("stream_placeholder_filter", "evals", f"SELECT event_id, score FROM (SELECT *, {PLACE} AS p FROM evals) WHERE NOT p AND score <> 32002")
def _(v):
    """Games go on from wave to wave: a game's last score is carried over."""
    return in_waves(v("evals"), "placeholder", "game_id", C("ply"), streams.stream_placeholder_filter).select("event_id", "score")


#: Counts are halved after every 10 000th record of a shard; instead, later records weigh twice as much here, which leaves all shares as they are.
RUNNING = f"""WITH {TARGETS},
numbered AS (SELECT CAST(event_id % 4 AS INT) AS shard, event_id AS row_id, piece_count, row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) AS n, {u('event_id', chr(39) + 'pieces' + chr(39))} AS u FROM evals),
weighed AS (SELECT *, pow(2.0e0, (n - 1) // 10000) AS x, n IN (100, 500, 1000, 2500, 5000) OR n % 10000 = 0 AS anew FROM numbered),
running AS (SELECT *, sum(x) OVER (PARTITION BY shard ORDER BY n) AS every, sum(x) OVER (PARTITION BY shard, piece_count ORDER BY n) AS own, max(CASE WHEN anew THEN n END) OVER (PARTITION BY shard ORDER BY n) AS since FROM weighed),
hist AS (SELECT r.shard, r.n AS since, w.piece_count, sum(w.x) AS c FROM weighed r JOIN weighed w ON w.shard = r.shard AND w.n <= r.n WHERE r.anew GROUP BY 1, 2, 3),
shares AS (SELECT shard, since, w, sum(c) OVER (PARTITION BY shard, since) * w / (total * c) AS ratio FROM hist JOIN targets USING (piece_count)),
factors AS (SELECT shard, since, 0.025e0 / min(ratio) AS factor FROM shares WHERE w > 0 GROUP BY 1, 2)"""


@query("stream_rebalance", "evals", f"{RUNNING} SELECT r.shard, row_id, r.piece_count FROM running r JOIN targets t ON t.piece_count = r.piece_count LEFT JOIN factors f ON f.shard = r.shard AND f.since = r.since WHERE u < least(1.0e0, CASE WHEN w > 0 THEN coalesce(factor, 1.0e0) * every * w / (total * own) ELSE 0.0e0 END)")
def _(v):
    """Running counts go on from wave to wave."""
    rows = v("evals").select((C("event_id") % 4).cast("int").alias("shard"), C("event_id").alias("row_id"), "piece_count")
    return in_waves(rows, "rebalance", "shard", C("row_id"), streams.stream_rebalance).select("shard", "row_id", "piece_count")
