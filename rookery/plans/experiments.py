"""Queries over game results, ratings, artefacts and training logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from rookery.functions.evalmath import elo, elo_error, lambda_jitter
from rookery.operators import analytics, batching, ratings, sequence
from rookery.plans.registry import query
from rookery.plans.sqltext import u
from rookery.sources import text

C = F.col


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


SIDES = "sides AS (SELECT game_no, white AS player, black AS opponent, result = '1-0' AS won, result = '1/2-1/2' AS drawn, result = '0-1' AS lost FROM games UNION ALL SELECT game_no, black, white, result = '0-1', result = '1/2-1/2', result = '1-0' FROM games)"
WDL = f"{SIDES}, wdl AS (SELECT *, points / games AS score_rate FROM (SELECT player, count(*) FILTER (WHERE won) AS wins, count(*) FILTER (WHERE drawn) AS draws, count(*) FILTER (WHERE lost) AS losses, count(*) FILTER (WHERE won OR drawn OR lost) AS games, count(*) FILTER (WHERE won) + 0.5e0 * count(*) FILTER (WHERE drawn) AS points FROM sides GROUP BY 1))"
ELO = "(-400 * log10(1 / greatest(0.001e0, least(0.999e0, score_rate)) - 1) + 0.0e0)"
STANDINGS = f"{WDL}, rated AS (SELECT *, CASE WHEN player = 'master' THEN 0.0e0 ELSE {ELO} END AS elo, CASE WHEN player <> 'master' THEN 400 / sqrt(games) END AS elo_error FROM wdl), standings AS (SELECT *, CAST(row_number() OVER (ORDER BY CASE WHEN player = 'master' THEN 0 ELSE -elo END, player) AS INT) AS place FROM rated)"
RATINGS = f"{STANDINGS}, ratings AS (SELECT player AS net, CAST(regexp_extract(player, 'run_([0-9]+)', 1) AS INT) AS run_id, CAST(regexp_extract(player, 'nn-epoch([0-9]+)', 1) AS INT) AS epoch, elo, elo_error, place AS line_no FROM standings WHERE contains(player, 'nn-epoch'))"


def rated(v):
    return ratings.rating_rows(ratings.standings(v("games")))


@query("both_perspectives", "games", f"WITH {SIDES} SELECT * FROM sides")
def _(v):
    return ratings.both_perspectives(v("games")).select("game_no", "player", "opponent", "won", "drawn", "lost")


@query("win_draw_loss", "games", f"WITH {WDL} SELECT player, wins, draws, losses, games, points, round(score_rate, 6) AS score_rate FROM wdl")
def _(v):
    return ratings.win_draw_loss(v("games")).select("player", "wins", "draws", "losses", "games", "points", *r6("score_rate"))


@query("elo", "games", f"WITH {WDL} SELECT player, round({ELO}, 6) AS elo, round(400 / sqrt(games), 6) AS elo_error FROM wdl")
def _(v):
    return ratings.win_draw_loss(v("games")).select("player", F.round(elo(C("score_rate")), 6).alias("elo"), F.round(elo_error(C("games")), 6).alias("elo_error"))


@query("standings", "games", f"WITH {STANDINGS} SELECT player, wins, draws, losses, games, points, round(score_rate, 6) AS score_rate, round(elo, 6) AS elo, round(elo_error, 6) AS elo_error, place FROM standings")
def _(v):
    return ratings.standings(v("games")).select("player", "wins", "draws", "losses", "games", "points", *r6("score_rate", "elo", "elo_error"), "place")


@query("leaderboard", "games", f"WITH {STANDINGS} SELECT player, place FROM standings")
def _(v):
    return ratings.leaderboard(ratings.standings(v("games")).drop("place")).select("player", "place")


@query("write_rating_table", "games", f"WITH {STANDINGS} SELECT place, concat('   ', lpad(place::VARCHAR, 2, ' '), ' ', CASE WHEN length(player) < 26 THEN rpad(player, 26, ' ') ELSE player END, ' : ', lpad(CASE WHEN player = 'master' THEN '0.0' ELSE printf('%.1f', elo) END, 7, ' '), ' ', lpad(CASE WHEN player = 'master' THEN '----' ELSE printf('%.1f', elo_error) END, 6, ' '), ' ', lpad(printf('%.1f', points), 9, ' '), ' ', lpad(games::VARCHAR, 7, ' '), ' ', lpad(CAST(round_even(score_rate * 100, 0) AS INT)::VARCHAR, 4, ' ')) AS line FROM standings")
def _(v):
    return text.rating_lines(ratings.standings(v("games")))


@query("read_rating_table", "games", f"WITH {RATINGS} SELECT net, run_id, epoch, round(elo, 1) AS elo, round(elo_error, 1) AS elo_error FROM ratings")
def _(v):
    lines = text.rating_lines(ratings.standings(v("games")))
    return text.parse_rating_lines(lines, "line").select("net", "run_id", "epoch", "elo", "elo_error")


@query("read_game_results", "games", "SELECT white, black, result FROM games")
def _(v):
    tags = F.concat(F.lit('"g"]\n[White "'), "white", F.lit('"]\n[Black "'), "black", F.lit('"]\n[Result "'), "result", F.lit('"]\n'))
    return text.parse_game_text(v("games").select(tags.alias("value")))


@query("read_match_progress", "games", f"WITH {WDL} SELECT CAST(regexp_extract(player, 'run_([0-9]+)', 1) AS INT) AS run_id, CAST(regexp_extract(player, 'nn-epoch([0-9]+)', 1) AS INT) AS epoch, CAST(wins AS INT) AS wins, CAST(losses AS INT) AS losses, CAST(draws AS INT) AS draws, round(score_rate, 6) AS score_rate FROM wdl WHERE player <> 'master'")
def _(v):
    t = ratings.win_draw_loss(v("games")).where("player <> 'master'")
    line = F.concat(F.lit("Score of master vs "), "player", F.lit(": "), C("losses").cast("string"), F.lit(" - "), C("wins").cast("string"), F.lit(" - "), C("draws").cast("string"))
    return text.parse_match_progress(t.select(line.alias("value"))).select("run_id", "epoch", "wins", "losses", "draws", *r6("score_rate"))


@query("read_training_log", "train_log", "SELECT run_id, epoch, step, CAST(100000 AS BIGINT) AS steps_total, 12.5e0 AS rate, train_loss AS loss FROM train_log")
def _(v):
    line = F.concat(F.lit("Epoch "), C("epoch").cast("string"), F.lit(" (Train): 50%| "), C("step").cast("string"), F.lit("/100000 [00:10<00:10, 12.50it/s, train_loss="), F.format_string("%.6f", "train_loss"), F.lit(", v_num=0]"))
    return text.parse_training_log(v("train_log").select("run_id", line.alias("value"))).select("run_id", "epoch", "step", "steps_total", "rate", "loss")


@query("explore_candidates", "games", f"WITH {RATINGS} SELECT net, round(elo + 1.5e0 * elo_error, 6) AS bound FROM ratings ORDER BY elo + 1.5e0 * elo_error DESC, net LIMIT 3")
def _(v):
    return ratings.explore_candidates(rated(v)).select("net", *r6("bound"))


BEST = f"{RATINGS}, best AS (SELECT * FROM ratings ORDER BY elo - elo_error DESC, run_id, epoch LIMIT 1)"


@query("conservative_best", "games", f"WITH {BEST} SELECT net, run_id, epoch, round(elo, 6) AS elo FROM best")
def _(v):
    return ratings.conservative_best(rated(v)).select("net", "run_id", "epoch", *r6("elo"))


@query("pending_conversions", "artifacts", "SELECT path, run_id, epoch FROM artifacts c WHERE kind = 'ckpt' AND epoch IS NOT NULL AND NOT EXISTS (SELECT 1 FROM artifacts n WHERE n.kind = 'nnue' AND n.run_id = c.run_id AND n.epoch = c.epoch)")
def _(v):
    return ratings.pending_conversions(v("artifacts")).select("path", "run_id", "epoch")


@query("match_ratings", "games artifacts", f"WITH {RATINGS} SELECT a.path, round(coalesce(arg_max(r.elo, r.line_no), -500), 6) AS elo, round(coalesce(arg_max(r.elo_error, r.line_no), 1000), 6) AS elo_error FROM (SELECT path FROM artifacts WHERE kind = 'nnue') a LEFT JOIN ratings r ON contains(a.path, r.net) GROUP BY 1")
def _(v):
    nets = v("artifacts").where("kind = 'nnue'")
    return ratings.match_ratings(nets, rated(v)).select("path", *r6("elo", "elo_error"))


@query("best_checkpoint_path", "games artifacts", f"WITH {BEST} SELECT b.run_id, b.epoch, arg_min(a.path, CASE a.kind WHEN 'ckpt' THEN 0 ELSE 1 END) AS path FROM best b LEFT JOIN artifacts a ON a.run_id = b.run_id AND a.epoch = b.epoch GROUP BY 1, 2")
def _(v):
    return ratings.best_checkpoint_path(rated(v), v("artifacts"))


@query("retention_plan", "games artifacts", f"WITH {RATINGS}, bad AS (SELECT run_id, epoch FROM (SELECT *, row_number() OVER (ORDER BY elo DESC, net) AS k FROM ratings) WHERE k > 16) SELECT path, a.run_id, a.epoch, CASE WHEN b.epoch IS NULL THEN 'keep' ELSE 'delete' END AS action FROM artifacts a LEFT JOIN bad b ON a.run_id = b.run_id AND a.epoch = b.epoch")
def _(v):
    return ratings.retention_plan(rated(v), v("artifacts"))


@query("checkpoint_retention", "artifacts", "SELECT path, run_id, epoch, CASE WHEN epoch IS NULL OR row_number() OVER (PARTITION BY run_id ORDER BY epoch DESC NULLS LAST, path) <= 3 THEN 'keep' ELSE 'delete' END AS action FROM artifacts WHERE kind = 'ckpt'")
def _(v):
    return ratings.checkpoint_retention(v("artifacts"), 3)


@query("latest_artifact", "artifacts", "SELECT path FROM artifacts ORDER BY mtime DESC, path DESC LIMIT 1")
def _(v):
    return ratings.latest_artifact(v("artifacts"))


@query("elo_curve", "games", f"WITH {RATINGS}, near AS (SELECT *, max(elo) OVER (PARTITION BY run_id) AS top FROM ratings) SELECT run_id, epoch, round(elo, 6) AS elo, round(elo_error, 6) AS elo_error FROM (SELECT *, row_number() OVER (PARTITION BY run_id, epoch ORDER BY line_no) AS k FROM near WHERE elo >= top - 50) WHERE k = 1")
def _(v):
    return ratings.elo_curve(rated(v)).select("run_id", "epoch", *r6("elo", "elo_error"))


ONE = "one AS (SELECT run_id, step, min(ts) AS ts, min(train_loss) AS train_loss FROM train_log GROUP BY 1, 2)"


def one_per_step(v):
    return v("train_log").groupBy("run_id", "step").agg(F.min("ts").alias("ts"), F.min("train_loss").alias("train_loss"))


@query("decayed_average", "train_log", f"WITH {ONE}, k AS (SELECT *, count(*) OVER (PARTITION BY run_id) - row_number() OVER (PARTITION BY run_id ORDER BY step) AS d, count(*) OVER (PARTITION BY run_id) AS n FROM one) SELECT run_id, any_value(n) AS n, round(sum(train_loss * pow(0.995e0, d)) / sum(pow(0.995e0, d)), 6) AS average FROM k GROUP BY 1")
def _(v):
    return sequence.decayed_average(one_per_step(v), "run_id", ["step"], "train_loss", buckets=F.floor(C("step") / 4096)).select("run_id", "n", *r6("average"))


@query("throughput", "train_log", f"WITH {ONE}, s AS (SELECT *, step - lag(step) OVER w AS ds, (epoch_us(ts::TIMESTAMP) - epoch_us(lag(ts) OVER w)) / 1000000.0e0 AS dt FROM one WHERE step % 10 = 0 WINDOW w AS (PARTITION BY run_id ORDER BY ts, step)) SELECT run_id, step, round(ds / dt, 9) AS rate, round((100000 - step) / (ds / dt), 3) AS eta_s FROM s WHERE ds > 0 AND dt > 0")
def _(v):
    rows = one_per_step(v).withColumn("total", F.lit(100_000))
    return sequence.throughput(rows, total="total").select("run_id", "step", F.round("rate", 9).alias("rate"), F.round("eta_s", 3).alias("eta_s"))


@query("first_non_finite", "train_log", "SELECT run_id, 'train_loss' AS phase, min(step) AS step FROM train_log WHERE step % 97 = 0 GROUP BY 1")
def _(v):
    spoiled = v("train_log").withColumn("train_loss", F.when(C("step") % 97 == 0, float("nan")).otherwise(C("train_loss")))
    return sequence.first_non_finite(spoiled)


@query("run_status", "train_log", "WITH l AS (SELECT run_id, max(epoch) AS e FROM train_log GROUP BY 1), s AS (SELECT t.run_id, e, max(step) AS s FROM train_log t JOIN l ON l.run_id = t.run_id AND l.e = t.epoch GROUP BY 1, 2) SELECT run_id, e AS last_epoch, s AS last_step, e = 7 AND s >= 60000 * 0.9e0 AS finished FROM s")
def _(v):
    return sequence.run_status(v("train_log").withColumn("steps_total", F.lit(60_000)), 8)


@query("epoch_loss", "train_log", "WITH r AS (SELECT run_id, epoch, step % 4 AS rank, avg(train_loss) AS l FROM train_log GROUP BY 1, 2, 3) SELECT run_id, epoch, round(avg(l), 6) AS loss FROM r GROUP BY 1, 2")
def _(v):
    return analytics.epoch_loss(v("train_log").withColumn("rank", C("step") % 4)).select("run_id", "epoch", *r6("loss"))


@query("loss_curve", "train_log", "WITH m AS (SELECT *, min(val_loss) OVER (PARTITION BY run_id) AS low FROM train_log) SELECT run_id, step, round(min(val_loss), 6) AS loss FROM m WHERE val_loss < low + 0.002e0 GROUP BY 1, 2")
def _(v):
    return analytics.loss_curve(v("train_log"), 0.002).select("run_id", "step", *r6("loss"))


#: A normal draw by key, as stable_normal makes it.
NORMAL = lambda key, salt: f"(sqrt(-2 * ln(greatest({u(key, repr(salt + 'a'))}, pow(2.0e0, -33)))) * cos(2 * pi() * {u(key, repr(salt + 'b'))}))"


@query("batch_jitter", "train_log", f"""WITH s AS (SELECT step, row_number() OVER (ORDER BY step) - 1 AS batch FROM (SELECT DISTINCT step FROM train_log)),
d AS (SELECT *, {NORMAL('batch', 'batch')} * 0.05e0 * sqrt(1 - 0.9e0 * 0.9e0) AS draw FROM s)
SELECT a.batch, round(sum(b.draw * pow(0.9e0, a.batch - b.batch)), 6) + 0.0e0 AS jitter FROM d a JOIN d b ON b.batch BETWEEN a.batch - 400 AND a.batch GROUP BY 1""")
def _(v):
    """A batch per step of the log; in SQL, draws more than 400 batches old, of weight 0.9 ** 400, are left out."""
    steps = v("train_log").select("step").distinct()
    batches = batching.global_index(steps, ["step"], F.floor(F.col("step") / 100_000), "batch")
    return sequence.batch_jitter(batches, "batch", 0.05, 0.9).select("batch", (F.round("jitter", 6) + F.lit(0.0)).alias("jitter"))


@query("lambda_jitter", "evals", f"SELECT event_id, round(greatest(0.0e0, least(1.0e0, 0.75e0 + 0.1e0 * {NORMAL('event_id', 'lambda')})), 6) AS lam FROM evals")
def _(v):
    return v("evals").select("event_id", F.round(lambda_jitter(F.lit(0.75), 0.1, "event_id"), 6).alias("lam"))
