"""Live forms: training rows from arriving files, standings, averages, alarms and filters with state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rookery.functions.board import material_eval, parse_fen
from rookery.functions.hashing import stable_uniform
from rookery.operators.features import ALL_FEATURES, feature_arrays, feature_layout, is_quiet, padded
from rookery.operators.filters import NO_SCORE, SkipConfig, piece_count_weight, reject_reason
from rookery.operators.ratings import both_perspectives, rate

#: After how many records the balance is set anew, and from which one the counts are halved each time.
REFRESH = (100, 500, 1000, 2500, 5000)
HALVE = 10_000


def training_rows(records: DataFrame, cfg: SkipConfig, key: str, name: str = ALL_FEATURES) -> DataFrame:
    """(key, us, score, result, piece_count, white, black): rules that look at one record only, then each side's features, sorted and
    padded with -1: no state and no shuffle, so the same for batch and stream. The rule of quiet positions reads move_from and move_to, or move."""
    ends = [F.col(c) for c in (("move_from", "move_to") if "move_from" in records.columns else ("move.from", "move.to"))]
    kept = parse_fen(records.where(reject_reason(cfg, key, None, None, None).isNull()))
    if cfg.quiet:
        kept = kept.where(is_quiet(*ends))
    if cfg.least_material > 0:
        kept = kept.where(F.abs(material_eval(F.col("board"), F.col("white_to_move"))) >= cfg.least_material)
    most = sum(n for *_, n in feature_layout(name))
    us = F.col("white_to_move").cast("int").cast("double").alias("us")
    return feature_arrays(kept, name, [key, "white_to_move", "score", "result", "piece_count"]).select(key, us, "score", "result", "piece_count", *[padded(F.col(c), most).alias(c) for c in ("white", "black")])


def stream_training_rows(spark: SparkSession, source: str, schema, out: str, checkpoint: str, cfg: SkipConfig, key: str, files_per_trigger: int = 64, name: str = ALL_FEATURES):
    """Record files of a folder, as they arrive, to Parquet training rows, each exactly once; stops when what is there is done."""
    records = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    return write_training_rows(records, out, checkpoint, cfg, key, name)


def write_training_rows(records: DataFrame, out: str, checkpoint: str, cfg: SkipConfig, key: str, name: str = ALL_FEATURES):
    """A stream of records, of Parquet or of chunk files (stream_binpack), to Parquet training rows, as stream_training_rows does."""
    rows = training_rows(records, cfg, key, name)
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_standings(games: DataFrame, out: str, checkpoint: str, anchor: str = "master"):
    """A streaming table of games to a leaderboard in `out`, rewritten whole at every trigger: one row per player."""
    points = both_perspectives(games).groupBy("player").agg(F.count_if("won").alias("wins"), F.count_if("drawn").alias("draws"), F.count_if("lost").alias("losses"))

    def refresh(batch: DataFrame, _: int) -> None:
        rate(batch, anchor).write.mode("overwrite").parquet(out)

    return points.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(refresh).start()


class DecayedAverage(StatefulProcessor):
    """Keeps (total, weight) of a run; every batch of rows, in order of step, moves it on."""

    def __init__(self, decay: float):
        self.decay = decay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("average", "total double, weight double, n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total, weight, n = self.state.get() if self.state.exists() else (0.0, 0.0, 0)
        values = pd.concat(list(rows)).sort_values("step")["value"].dropna().to_numpy(float)
        if len(values):
            ages = self.decay ** np.arange(len(values) - 1, -1, -1, dtype=float)
            past = self.decay ** len(values)
            total, weight, n = total * past + float(values @ ages), weight * past + float(ages.sum()), n + len(values)
        self.state.update((total, weight, n))
        yield pd.DataFrame({"run_id": [key[0]], "n": [n], "average": [total / weight if weight else float("nan")]})

    def close(self) -> None:
        pass


def stream_decayed_average(log: DataFrame, decay: float = 0.995) -> DataFrame:
    """(run_id, n, average) of a streaming log (run_id, step, value): a row per run and trigger; the newest is the run's average. Rows of
    a trigger are put in order of step and held in memory, so triggers must be bounded and come in that order."""
    rows = log.select(F.col("run_id").cast("int").alias("run_id"), F.col("step").cast("bigint").alias("step"), F.col("value").cast("double").alias("value"))
    return rows.groupBy("run_id").transformWithStateInPandas(DecayedAverage(decay), "run_id int, n bigint, average double", "Update", "None")


def stream_nan_alarm(log: DataFrame, run: str = "run_id", loss: str = "loss") -> DataFrame:
    """The first record of each run whose loss isn't finite; later ones of the run are dropped."""
    bad = F.isnan(loss) | (F.abs(loss) == float("inf"))
    return log.where(F.col(loss).isNotNull() & bad).dropDuplicates([run])


class PlaceholderFilter(StatefulProcessor):
    """Keeps a game's last ply and last valid score; passes on records that aren't placeholder zeros or without a score."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "ply int, score int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ply, score = self.state.get() if self.state.exists() else (-1, NO_SCORE)
        batch = pd.concat(list(rows)).sort_values("ply")
        keep = []
        for r in batch.itertuples():
            zero = r.score == 0 and r.result != 0 and r.ply > ply and score != NO_SCORE and abs(score) > 100
            ply = int(r.ply)
            keep.append(not zero and r.score != NO_SCORE)
            if keep[-1]:
                score = int(r.score)
        self.state.update((ply, score))
        yield batch[keep]

    def close(self) -> None:
        pass


def stream_placeholder_filter(records: DataFrame) -> DataFrame:
    """(game_id, event_id, ply, score, result) of a streaming table, without placeholder zeros and records without a score."""
    schema = "game_id bigint, event_id bigint, ply int, score int, result int"
    rows = records.selectExpr(*[f"cast({c.split()[0]} as {c.split()[1]}) {c.split()[0]}" for c in schema.split(", ")])
    return rows.groupBy("game_id").transformWithStateInPandas(PlaceholderFilter(), schema, "Append", "None")


class Rebalance(StatefulProcessor):
    """Keeps the piece counts of a shard and the factor of its keep rates, which is set anew at the steps of REFRESH and every HALVE."""

    def __init__(self, weights: list[float], floor: float):
        self.weights, self.floor = weights, floor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("counts", "counts array<double>, factor double, n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        counts, factor, n = self.state.get() if self.state.exists() else ([0.0] * 33, 1.0, 0)
        counts, w, total_w = list(counts), self.weights, sum(self.weights)
        batch = pd.concat(list(rows)).sort_values("u_order")
        keep = []
        for r in batch.itertuples():
            pc, rate = int(r.piece_count), 0.0
            if 0 <= pc <= 32:
                counts[pc] += 1
                n += 1
                if n in REFRESH or n % HALVE == 0:
                    ratios = [sum(counts) * w[i] / (total_w * counts[i]) for i in range(33) if w[i] > 0 and counts[i] > 0]
                    factor = self.floor / min(ratios) if ratios else factor
                    if n % HALVE == 0:
                        counts = [c / 2 for c in counts]
                rate = factor * sum(counts) * w[pc] / (total_w * counts[pc]) if w[pc] > 0 else 0.0
            keep.append(r.u < min(1.0, rate))
        self.state.update((counts, factor, n))
        yield batch[keep][["shard", "row_id", "piece_count"]]

    def close(self) -> None:
        pass


def stream_rebalance(records: DataFrame, y: tuple[float, ...] = SkipConfig.piece_count_y, floor: float = 0.025) -> DataFrame:
    """(shard, row_id, piece_count) of a streaming table of the same columns, thinned by running counts per shard."""
    spark = records.sparkSession
    weights = [r.w for r in spark.range(33).select("id", piece_count_weight(F.col("id"), y).alias("w")).orderBy("id").collect()]
    weights = weights if sum(weights) > 0 else [1.0] * 33
    rows = records.select(F.col("shard").cast("int").alias("shard"), F.col("row_id").cast("bigint").alias("row_id"), F.col("piece_count").cast("int").alias("piece_count"))
    rows = rows.withColumns({"u": stable_uniform("row_id", "pieces"), "u_order": F.col("row_id")})
    return rows.groupBy("shard").transformWithStateInPandas(Rebalance(weights, floor), "shard int, row_id bigint, piece_count int", "Append", "None")
