"""Game results to ratings, and what ratings decide about checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rookery.functions.evalmath import elo, elo_error

RESULTS = ("1-0", "0-1", "1/2-1/2")


def both_perspectives(games: DataFrame) -> DataFrame:
    """Each game as two rows (player, opponent, won, drawn, lost), reading it once. Results other than the three count for neither."""
    side = lambda me, other, win, loss: F.struct(F.col(me).alias("player"), F.col(other).alias("opponent"), (F.col("result") == win).alias("won"), (F.col("result") == "1/2-1/2").alias("drawn"), (F.col("result") == loss).alias("lost"))
    return games.select("*", F.explode(F.array(side("white", "black", "1-0", "0-1"), side("black", "white", "0-1", "1-0"))).alias("__g")).select(*games.columns, "__g.*")


def win_draw_loss(games: DataFrame) -> DataFrame:
    """(player, wins, draws, losses, games, points, score_rate)."""
    return with_points(both_perspectives(games).groupBy("player").agg(F.count_if("won").alias("wins"), F.count_if("drawn").alias("draws"), F.count_if("lost").alias("losses")))


def with_points(counts: DataFrame) -> DataFrame:
    """counts (player, wins, draws, losses) with games, points and score_rate."""
    rows = counts.withColumn("games", F.col("wins") + F.col("draws") + F.col("losses")).withColumn("points", F.col("wins") + F.col("draws") * F.lit(0.5))
    return rows.withColumn("score_rate", F.when(F.col("games") > 0, F.col("points") / F.col("games")))


def leaderboard(standings: DataFrame, anchor: str = "master") -> DataFrame:
    """standings with place: by descending elo, the anchor where elo is 0, ties by name. One row per player meets in one task."""
    key = F.when(F.col("player") == anchor, 0.0).otherwise(-F.col("elo"))
    return standings.withColumn("place", F.row_number().over(W.orderBy(key, "player")))


def standings(games: DataFrame, anchor: str = "master") -> DataFrame:
    """win_draw_loss with elo against the anchor, its error and the place; the anchor has elo 0 and no error."""
    return rate(win_draw_loss(games), anchor)


def rate(counts: DataFrame, anchor: str = "master") -> DataFrame:
    """standings from counts (player, wins, draws, losses)."""
    rows = with_points(counts)
    own = F.col("player") == anchor
    rows = rows.withColumns({"elo": F.when(own, 0.0).otherwise(elo(F.col("score_rate"))), "elo_error": F.when(~own, elo_error(F.col("games")))})
    return leaderboard(rows, anchor)


def rating_rows(standings_df: DataFrame) -> DataFrame:
    """ratings (net, run_id, epoch, elo, elo_error, line_no) of the players that are nets."""
    name = F.col("player")
    rows = standings_df.where(name.contains("nn-epoch"))
    return rows.select(name.alias("net"), F.regexp_extract(name, r"run_(\d+)", 1).cast("int").alias("run_id"), F.regexp_extract(name, r"nn-epoch(\d+)", 1).cast("int").alias("epoch"), "elo", "elo_error", F.col("place").alias("line_no"))


def pending_conversions(artifacts: DataFrame) -> DataFrame:
    """Checkpoints for which no net of their run and epoch exists."""
    nets = artifacts.where("kind = 'nnue'").select("run_id", "epoch")
    return artifacts.where("kind = 'ckpt' AND epoch IS NOT NULL").join(nets, ["run_id", "epoch"], "left_anti")


def match_ratings(nets: DataFrame, ratings: DataFrame, path: str = "path") -> DataFrame:
    """(path, elo, elo_error) for each net file: the last rating whose net name stands anywhere in the path, else -500 and 1000.

    Names have few different lengths; every stretch of a path that is as long as some name is looked up among the names, so
    the match is an equal join whatever the names are. Empty names match nothing.
    """
    files = nets.select(F.col(path).alias("path"))
    named = ratings.where(F.length("net") > 0)
    lengths = named.agg(F.collect_set(F.length("net")).alias("__lengths"))  # one row, no longer than the longest path
    parts = lambda n: F.transform(F.sequence(F.lit(1), F.length("path") - n + 1), lambda i: F.substring(F.col("path"), i, n))
    fitting = F.filter("__lengths", lambda n: n <= F.length("path"))
    keyed = files.distinct().crossJoin(F.broadcast(lengths)).select("path", F.explode(F.array_distinct(F.flatten(F.transform(fitting, parts)))).alias("net"))
    best = keyed.join(named, "net").groupBy("path").agg(F.max_by(F.struct("elo", "elo_error"), "line_no").alias("r"))
    out = files.join(best, "path", "left")
    return out.select("path", F.coalesce("r.elo", F.lit(-500.0)).alias("elo"), F.coalesce("r.elo_error", F.lit(1000.0)).alias("elo_error"))


def explore_candidates(ratings: DataFrame, factor: float = 1.5, k: int = 3, name: str = "net") -> DataFrame:
    """The k nets most worth playing: highest elo + factor * error."""
    return ratings.withColumn("bound", F.col("elo") + factor * F.col("elo_error")).orderBy(F.col("bound").desc(), name).limit(k)


def conservative_best(ratings: DataFrame) -> DataFrame:
    """One row: the rating with the highest elo - error, the first by name among equals."""
    return ratings.agg(F.max_by(F.struct("net", "run_id", "epoch", "elo", "elo_error"), F.struct(F.col("elo") - F.col("elo_error"), -F.col("run_id"), -F.col("epoch"))).alias("b")).select("b.*")


def best_checkpoint_path(ratings: DataFrame, artifacts: DataFrame) -> DataFrame:
    """One row (run_id, epoch, path): the file of the best net, its checkpoint before its net; no path if there is no file."""
    best = conservative_best(ratings).select("run_id", "epoch")
    files = artifacts.where("epoch IS NOT NULL").select("run_id", "epoch", "path", F.when(F.col("kind") == "ckpt", 0).otherwise(1).alias("rank"))
    return best.join(files, ["run_id", "epoch"], "left").groupBy("run_id", "epoch").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))


def retention_plan(ratings: DataFrame, artifacts: DataFrame, keep: int = 16) -> DataFrame:
    """artifacts (path, run_id, epoch) with action: `delete` for files of rated nets beyond the best `keep`, else `keep`. Nothing is deleted."""
    ranked = ratings.withColumn("__r", F.row_number().over(W.orderBy(F.col("elo").desc(), "net")))
    worse = ranked.where(F.col("__r") > keep).select("run_id", "epoch", F.lit(True).alias("__bad")).distinct()
    out = artifacts.join(worse, ["run_id", "epoch"], "left")
    return out.select("path", "run_id", "epoch", F.when(F.col("__bad"), "delete").otherwise("keep").alias("action"))


def checkpoint_retention(artifacts: DataFrame, k: int) -> DataFrame:
    """Checkpoints with action: the newest k epochs of a run stay, and last.ckpt; all if k is negative."""
    rows = artifacts.where("kind = 'ckpt'")
    newest = F.row_number().over(W.partitionBy("run_id").orderBy(F.col("epoch").desc_nulls_last(), "path"))
    stays = F.col("epoch").isNull() | (F.lit(k) < 0) | (newest <= k)
    return rows.select("path", "run_id", "epoch", F.when(stays, "keep").otherwise("delete").alias("action"))


def latest_artifact(artifacts: DataFrame) -> DataFrame:
    return artifacts.agg(F.max_by("path", F.struct("mtime", "path")).alias("path"))


def elo_curve(ratings: DataFrame, reach: float = 50.0) -> DataFrame:
    """(run_id, epoch, elo, elo_error): ratings within reach of the run's best, the first of each epoch."""
    by_run = W.partitionBy("run_id")
    near = ratings.withColumn("__top", F.max("elo").over(by_run)).where(F.col("elo") >= F.col("__top") - reach)
    first = near.withColumn("__k", F.row_number().over(W.partitionBy("run_id", "epoch").orderBy("line_no"))).where("__k = 1")
    return first.select("run_id", "epoch", "elo", "elo_error")
