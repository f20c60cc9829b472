"""Queries over records of scored positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rookery.functions import evalmath as M
from rookery.functions.hashing import stable_uniform
from rookery.operators import analytics, batching, filters, fitting, sequence
from rookery.plans.positions import CAPTURE, CHECKED, MATERIAL
from rookery.plans.registry import query
from rookery.plans.sqltext import LOSS, REMAP, RESULT_PROB, SOFT, TARGETS, WIN, expected, u

C = F.col
VALID = "score <> 32002"


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query("outcome", "evals", "SELECT event_id, (result + 1) / 2.0e0 AS outcome FROM evals")
def _(v):
    return v("evals").select("event_id", M.outcome(C("result")).alias("outcome"))


@query("piece_bucket", "evals", "SELECT event_id, CAST((piece_count - 1) // 4 AS INT) AS bucket FROM evals")
def _(v):
    return v("evals").select("event_id", M.piece_bucket(C("piece_count")).alias("bucket"))


@query("wdl_prob", "evals", f"SELECT event_id, round({WIN}, 6) AS w, round(1 - {WIN} - {LOSS}, 6) + 0.0e0 AS d, round({LOSS}, 6) AS l FROM evals")
def _(v):
    return v("evals").select("event_id", M.wdl_prob(C("score"), C("ply")).alias("p")).select("event_id", *[(F.round(f"p.{x}", 6) + F.lit(0.0)).alias(x) for x in "wdl"])


@query("result_prob", "evals", f"SELECT event_id, round({RESULT_PROB}, 6) AS p FROM evals")
def _(v):
    return v("evals").select("event_id", F.round(M.result_prob(C("score"), C("ply"), C("result")), 6).alias("p"))


@query("remap_mate_score", "evals", f"SELECT event_id, round({REMAP}, 6) AS remapped FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN sign(score) * (31700 + event_id % 301) ELSE score END AS score FROM evals)")
def _(v):
    mates = F.when(C("event_id") % 11 == 0, F.signum("score") * (31700 + C("event_id") % 301)).otherwise(C("score"))
    return v("evals").select("event_id", F.round(M.remap_mate_score(mates), 6).alias("remapped"))


@query("expected_score", "evals", f"SELECT event_id, round({expected('score', 280, 353)}, 6) AS q FROM evals WHERE {VALID}")
def _(v):
    return v("evals").where(VALID).select("event_id", F.round(M.expected_score(C("score"), 280, 353), 6).alias("q"))


PF, QF = expected(REMAP, 270, 380), expected("(score + event_id % 41 - 20)", 270, 340)
PT = f"(0.75e0 * {PF} + 0.25e0 * (result + 1) / 2.0e0)"


@query("blend_target", "evals", f"SELECT event_id, round({PT}, 6) AS pt FROM evals WHERE {VALID}")
def _(v):
    pf = M.expected_score(M.remap_mate_score(C("score")), 270, 380)
    return v("evals").where(VALID).select("event_id", F.round(M.blend_target(pf, M.outcome(C("result")), 0.75), 6).alias("pt"))


LOSS_SQL = f"""WITH q AS (SELECT event_id, source, {QF} AS qf, {PF} AS pf, {PT} AS pt FROM evals WHERE {VALID}),
l AS (SELECT *, pow(abs(pt - qf), 2.5e0) * CASE WHEN qf > pt THEN 1.2e0 ELSE 1 END AS loss, 1 + (pow(2.0e0, 0.5e0) - 1) * pow(greatest(0.0e0, pow(pf - 0.5e0, 2) * pf * (1 - pf)), 0.5e0) AS weight FROM q)"""
LOSS_PARAMS = M.LossParams(asymmetry=0.2, w1=0.5, lam=0.75)


@query("pointwise_loss", "evals", LOSS_SQL + " SELECT event_id, round(loss, 6) AS loss, round(weight, 6) AS weight FROM l")
def _(v):
    x = analytics.loss_columns(C("score") + C("event_id") % 41 - 20, C("score"), M.outcome(C("result")), LOSS_PARAMS)
    return v("evals").where(VALID).select("event_id", x.alias("x")).select("event_id", F.round("x.loss", 6).alias("loss"), F.round("x.weight", 6).alias("weight"))


@query("weighted_loss", "evals", LOSS_SQL + " SELECT source, round(sum(loss * weight) / sum(weight), 6) AS loss FROM l GROUP BY source")
def _(v):
    df = v("evals").where(VALID).withColumn("net", C("score") + C("event_id") % 41 - 20)
    return analytics.weighted_loss(df, "net", "score", M.outcome(C("result")), LOSS_PARAMS, by=("source",)).select("source", *r6("loss"))


LAMBDA = M.LambdaSchedule(1.0, 0.7, 40_000, 30_000, 0.25, 0.1)


@query("lambda_at", "train_log", """SELECT DISTINCT step, round(greatest(0.0e0, least(1.0e0, 1.0e0 - 0.3e0 * least(1.0e0, step / 30000.0e0) + 0.1e0 *
  CASE WHEN step >= 30000 THEN 0.0e0 WHEN step < 7500 THEN 0.5e0 * (1 - cos(pi() * step / 7500.0e0)) ELSE 0.5e0 * (1 + cos(pi() * (step - 7500) / 22500.0e0)) END)), 6) AS lam FROM train_log""")
def _(v):
    return v("train_log").select("step", F.round(M.lambda_at(C("step"), LAMBDA), 6).alias("lam")).distinct()


@query("stable_uniform", "evals", f"SELECT event_id, round({u('event_id', chr(39) + '7' + chr(39))}, 9) AS u FROM evals")
def _(v):
    return v("evals").select("event_id", F.round(stable_uniform("event_id", "7"), 9).alias("u"))


@query("drop_invalid_score", "evals", f"SELECT event_id, score FROM evals WHERE {VALID}")
def _(v):
    return filters.drop_invalid_score(v("evals")).select("event_id", "score")


PLACE = "(score = 0 AND result <> 0 AND coalesce(abs(last_value(CASE WHEN score NOT IN (0, 32002) THEN score END IGNORE NULLS) OVER (PARTITION BY game_id ORDER BY ply ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) > 100, false))"


@query("drop_placeholder_zero", "evals", f"SELECT event_id, score FROM (SELECT *, {PLACE} AS p FROM evals) WHERE NOT p")
def _(v):
    return filters.drop_placeholder_zero(v("evals"), ranges=12).select("event_id", "score")


@query("drop_early", "evals", "SELECT event_id, ply FROM evals WHERE ply > 12")
def _(v):
    return filters.drop_early(v("evals"), 12).select("event_id", "ply")


@query("thin_random", "evals", f"SELECT event_id FROM evals WHERE {u('event_id', chr(39) + 'random' + chr(39))} >= 3 / 4.0e0")
def _(v):
    return filters.thin_random(v("evals"), 3, "event_id").select("event_id")


@query("thin_by_result_prob", "evals", f"SELECT event_id FROM evals WHERE {u('event_id', chr(39) + 'result' + chr(39))} < {RESULT_PROB}")
def _(v):
    return filters.thin_by_result_prob(v("evals"), "event_id").select("event_id")


@query("thin_soft_early", "evals", f"SELECT event_id, ply FROM evals WHERE ply >= 20 OR {u('event_id', chr(39) + 'soft' + chr(39))} < {SOFT}")
def _(v):
    return filters.thin_soft_early(v("evals"), "event_id").select("event_id", "ply")


RATES = f"""{TARGETS},
hist AS (SELECT piece_count, count(*) AS n FROM kept GROUP BY 1),
ratios AS (SELECT h.piece_count, sum(n) OVER () * w / (total * n) AS ratio FROM hist h JOIN targets USING (piece_count)),
rates AS (SELECT piece_count, greatest(0.0e0, least(1.0e0, 0.025e0 / min(CASE WHEN ratio > 0 THEN ratio END) OVER () * ratio)) AS keep_rate FROM ratios)"""


@query("piece_count_rates", "evals", f"WITH kept AS (SELECT * FROM evals), {RATES} SELECT piece_count, round(keep_rate, 6) AS keep_rate FROM rates")
def _(v):
    return filters.piece_count_rates(v("evals")).select("piece_count", *r6("keep_rate"))


@query("piece_count_targets", "evals", f"WITH {TARGETS}, hist AS (SELECT piece_count, count(*) AS n FROM evals GROUP BY 1) SELECT t.piece_count, round(w, 6) AS w, round(total, 6) AS total, coalesce(n, 0) AS n FROM targets t LEFT JOIN hist USING (piece_count)")
def _(v):
    e = v("evals")
    hist = e.groupBy("piece_count").agg(F.count(F.lit(1)).alias("n"))
    return filters.piece_count_targets(e.sparkSession).join(hist, "piece_count", "left").select("piece_count", *r6("w", "total"), F.coalesce("n", F.lit(0)).alias("n"))


@query("rebalance_by_piece_count", "evals", f"WITH kept AS (SELECT * FROM evals), {RATES} SELECT event_id, piece_count FROM evals JOIN rates USING (piece_count) WHERE {u('event_id', chr(39) + 'pieces' + chr(39))} < keep_rate")
def _(v):
    return filters.rebalance_by_piece_count(v("evals"), "event_id").select("event_id", "piece_count")


CFG = filters.SkipConfig(quiet=False, thin_random=1, early=3)
REASONS = f"""WITH flagged AS (SELECT *, {PLACE} AS p FROM evals), firsts AS (SELECT *, CASE WHEN score = 32002 THEN 'no_score' WHEN p THEN 'placeholder_zero' WHEN ply <= 3 THEN 'early'
  WHEN {u('event_id', chr(39) + 'random' + chr(39))} < 0.5e0 THEN 'random' WHEN {u('event_id', chr(39) + 'result' + chr(39))} >= {RESULT_PROB} THEN 'result'
  WHEN ply < 20 AND {u('event_id', chr(39) + 'soft' + chr(39))} >= {SOFT} THEN 'soft_early' END AS r1 FROM flagged),
kept AS (SELECT * FROM firsts WHERE r1 IS NULL), {RATES},
reasons AS (SELECT event_id, ply, score, coalesce(r1, CASE WHEN coalesce({u('event_id', chr(39) + 'pieces' + chr(39))} >= keep_rate, true) THEN 'piece_count' END) AS reject_reason FROM firsts LEFT JOIN rates USING (piece_count))"""


@query("apply_skip_config", "evals", REASONS + " SELECT event_id, ply, score FROM reasons WHERE reject_reason IS NULL")
def _(v):
    return filters.apply_skip_config(v("evals"), CFG, "event_id").select("event_id", "ply", "score")


@query("skip_audit", "evals", REASONS + " SELECT coalesce(reject_reason, 'kept') AS reason, count(*) AS n FROM reasons GROUP BY 1")
def _(v):
    return filters.skip_audit(v("evals"), CFG, "event_id")


@query("assign_game_id", "evals", """WITH r AS (SELECT *, game_id % 8 AS part FROM evals), b AS (SELECT *, CASE WHEN coalesce(result = -lag(result) OVER w AND ply = lag(ply) OVER w + 1, false) THEN 0 ELSE 1 END AS begins FROM r WINDOW w AS (PARTITION BY part ORDER BY game_id, ply))
SELECT event_id, CAST(sum(begins) OVER (PARTITION BY part ORDER BY game_id, ply) AS BIGINT) AS game_no FROM b""")
def _(v):
    return sequence.assign_game_id(v("evals").withColumn("part", C("game_id") % 8), "part", ["game_id", "ply"], ranges=12).select("event_id", "game_no")


BUCKETS = "perf AS (SELECT CAST(round_even(score / 16.0e0, 0) * 16 AS BIGINT) AS bucket, sum((result + 1) / 2.0e0) AS total, count(*) AS n, avg((result + 1) / 2.0e0) AS mean FROM evals WHERE score <> 32002 GROUP BY 1)"


@query("score_bucket_performance", "evals", f"WITH {BUCKETS} SELECT bucket, total, n, round(mean, 6) AS mean, round(1.0e0 / n, 6) AS sigma FROM perf")
def _(v):
    return analytics.score_bucket_performance(v("evals").where(VALID)).select("bucket", "total", "n", *r6("mean", "sigma"))


def _step(i: int) -> str:
    s = f"(1 / (1 + exp(-bucket * k{i - 1}.k)))"
    slope = f"(bucket * {s} * (1 - {s}))"
    return f"k{i} AS (SELECT {i} AS step, any_value(k{i - 1}.k) + sum(n * n * {slope} * (mean - {s})) / sum(n * n * {slope} * {slope}) AS k FROM perf, k{i - 1})"


@query("sigmoid_scale_steps", "evals", f"WITH {BUCKETS}, k0 AS (SELECT 0 AS step, 1 / 361.0e0 AS k), {_step(1)}, {_step(2)}, {_step(3)} SELECT step, round(k, 9) AS k, round(1 / k, 4) AS inv_k FROM (SELECT * FROM k0 UNION ALL SELECT * FROM k1 UNION ALL SELECT * FROM k2 UNION ALL SELECT * FROM k3)")
def _(v):
    perf = analytics.score_bucket_performance(v("evals").where(VALID))
    return fitting.sigmoid_scale_steps(perf, 3).select("step", F.round("k", 9).alias("k"), F.round(1 / C("k"), 4).alias("inv_k"))


def _damped(i: int) -> str:
    """One step of the damped fit: what the sums are at the next k, and whether it is taken."""
    s = "(CASE WHEN bucket * k >= 0 THEN 1 / (1 + exp(-bucket * k)) ELSE exp(bucket * k) / (1 + exp(bucket * k)) END)"
    at = f"SELECT k, any_value(mu) AS mu, sum(n * n * (mean - {s}) * (mean - {s})) AS cost, sum(n * n * bucket * {s} * (1 - {s}) * (mean - {s})) AS a, sum(n * n * bucket * {s} * (1 - {s}) * bucket * {s} * (1 - {s})) AS b FROM perf, "
    if i == 0:
        return f"d0 AS MATERIALIZED ({at} (SELECT 1 / 361.0e0 AS k, 0.001e0 AS mu) s GROUP BY k)"
    was = f"d{i - 1}"
    take = lambda c: f"CASE WHEN t.cost < w.cost THEN t.{c} ELSE w.{c} END AS {c}"
    return (
        f"t{i} AS MATERIALIZED ({at} (SELECT k + a / (b * (1 + mu)) AS k, mu FROM {was}) s GROUP BY k), "
        f"d{i} AS MATERIALIZED (SELECT {', '.join(map(take, ('k', 'cost', 'a', 'b')))}, CASE WHEN t.cost < w.cost THEN w.mu / 10 ELSE w.mu * 10 END AS mu FROM {was} w, t{i} t)"
    )


@query("fit_sigmoid_scale", "evals", f"WITH {BUCKETS}, {', '.join(map(_damped, range(31)))} SELECT round(k, 7) AS k FROM d30")
def _(v):
    """The fit until it stands still; its SQL takes thirty steps, which is beyond that point."""
    perf = analytics.score_bucket_performance(v("evals").where(VALID))
    k, _inverse = fitting.fit_sigmoid_scale(perf)
    return perf.agg(F.round(F.max(F.lit(k)), 7).alias("k"))


@query("distribution", "evals", """WITH x AS (SELECT 'piece_count' AS what, least(piece_count, 33) AS value FROM evals UNION ALL SELECT 'ply', least(ply, 61) FROM evals)
SELECT what, value, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY what) AS DOUBLE), 6) AS share FROM x GROUP BY 1, 2""")
def _(v):
    e = v("evals")
    parts = [analytics.distribution(e, c, m).select(F.lit(c).alias("what"), "value", "n", *r6("share")) for c, m in (("piece_count", 32), ("ply", 60))]
    return parts[0].unionByName(parts[1])


def pairs(v):
    e = v("evals").where(VALID)
    return analytics.join_evals(e, e.withColumn("score", C("score") + C("event_id") % 41 - 20), "event_id")


PAIRS = f"""WITH pr AS (SELECT event_id, score::DOUBLE AS ref, (score + event_id % 41 - 20)::DOUBLE AS cmp FROM evals WHERE {VALID}),
er AS (SELECT *, abs(cmp - ref) AS abs_err, {expected('ref', 280, 353)} AS q_ref, {expected('cmp', 280, 353)} AS q_cmp FROM pr),
e AS (SELECT *, abs_err / greatest(abs(ref), 0.03125e0) AS rel_err, abs(q_cmp - q_ref) AS q_err FROM er)"""


@query("join_evals", "evals", PAIRS + " SELECT event_id, ref, cmp FROM pr")
def _(v):
    return pairs(v)


@query("compare_evals", "evals", PAIRS + """, m AS (SELECT avg(ref) AS mr, avg(q_ref) AS mq FROM e)
SELECT count(*) AS n, min(ref) AS ref_min, max(ref) AS ref_max, round(avg(abs(ref)), 6) AS ref_abs, min(cmp) AS cmp_min, max(cmp) AS cmp_max, round(avg(abs(cmp)), 6) AS cmp_abs,
  round(avg(abs_err), 6) AS abs_err, round(avg(rel_err), 6) AS rel_err, round(avg(q_err), 6) AS q_err,
  round(1 - sum((ref - cmp) * (ref - cmp)) / sum((ref - mr) * (ref - mr)), 6) AS r2_score, round(1 - sum((q_ref - q_cmp) * (q_ref - q_cmp)) / sum((q_ref - mq) * (q_ref - mq)), 6) AS r2_q FROM e, m""")
def _(v):
    out = analytics.compare_evals(pairs(v))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" and c[-4:] not in ("_min", "_max") else C(c) for c, t in out.dtypes])


@query("error_quantiles", "evals", PAIRS + "SELECT share, round(quantile_cont(abs_err, 0.6827), 6) AS abs_err, round(quantile_cont(q_err, 0.6827), 6) AS q_err FROM e, (SELECT 0.6827e0 AS share) GROUP BY share UNION ALL SELECT 0.9545e0, round(quantile_cont(abs_err, 0.9545), 6), round(quantile_cont(q_err, 0.9545), 6) FROM e UNION ALL SELECT 0.9973e0, round(quantile_cont(abs_err, 0.9973), 6), round(quantile_cont(q_err, 0.9973), 6) FROM e")
def _(v):
    return analytics.error_quantiles(pairs(v), exact=True).select("share", *r6("abs_err", "q_err"))


@query("error_quantiles_approx", "evals", PAIRS + "SELECT share, round(quantile_disc(abs_err, 0.6827), 6) AS abs_err, round(quantile_disc(q_err, 0.6827), 6) AS q_err FROM e, (SELECT 0.6827e0 AS share) GROUP BY share UNION ALL SELECT 0.9545e0, round(quantile_disc(abs_err, 0.9545), 6), round(quantile_disc(q_err, 0.9545), 6) FROM e UNION ALL SELECT 0.9973e0, round(quantile_disc(abs_err, 0.9973), 6), round(quantile_disc(q_err, 0.9973), 6) FROM e")
def _(v):
    """One mergeable pass; with this accuracy the sketch is exact up to half a million pairs."""
    return analytics.error_quantiles(pairs(v), accuracy=1_000_000).select("share", *r6("abs_err", "q_err"))


@query("worst_offenders", "evals", PAIRS + " SELECT event_id, ref, cmp, round(rel_err, 6) AS rel_err FROM e ORDER BY e.rel_err DESC, event_id LIMIT 5")
def _(v):
    return analytics.worst_offenders(pairs(v), "rel_err", "event_id").select("event_id", "ref", "cmp", *r6("rel_err"))


@query("shuffle_rows", "evals", f"SELECT event_id, round({u('event_id', chr(39) + 'shuffle0' + chr(39))}, 9) AS shuffle_key FROM evals")
def _(v):
    return batching.shuffle_rows(v("evals"), "event_id").select("event_id", F.round("shuffle_key", 9).alias("shuffle_key"))


@query("assign_shard", "evals", "SELECT event_id, CAST((event_id // 100) % 3 AS INT) AS shard FROM evals")
def _(v):
    return batching.assign_shard(v("evals").withColumn("chunk_no", F.floor(C("event_id") / 100)), 3).select("event_id", "shard")


@query("assign_batches", "evals", f"SELECT event_id, CAST((row_number() OVER (ORDER BY {u('event_id', chr(39) + 'shuffle0' + chr(39))}, event_id) - 1) // 256 AS BIGINT) AS batch_id FROM evals")
def _(v):
    return batching.assign_batches(v("evals"), "event_id", 256).select("event_id", "batch_id")


@query("mix_sources", "evals", f"WITH ch AS (SELECT concat(source, '-', CAST(event_id // 250 AS VARCHAR)) AS chunk, count(*) AS n FROM evals GROUP BY 1) SELECT chunk, n, round(-ln(greatest({u('chunk', chr(39) + 'mix0' + chr(39))}, pow(2.0e0, -33))) / n, 9) AS draw_key FROM ch")
def _(v):
    chunks = v("evals").groupBy(F.concat("source", F.lit("-"), F.floor(C("event_id") / 250).cast("string")).alias("chunk")).agg(F.count(F.lit(1)).alias("n"))
    return batching.mix_sources(chunks, "chunk", "n").select("chunk", "n", F.round("draw_key", 9).alias("draw_key"))


@query("repeat_epochs", "evals", f"SELECT event_id, CAST(p AS INT) AS pass, round({u('event_id', 'concat(' + chr(39) + 'shuffle0:' + chr(39) + ', CAST(p AS VARCHAR))')}, 9) AS shuffle_key FROM evals, range(3) r(p)")
def _(v):
    return batching.repeat_epochs(v("evals"), 3, "event_id").select("event_id", "pass", F.round("shuffle_key", 9).alias("shuffle_key"))


@query("concat_sources", "evals", "SELECT event_id, ply FROM evals WHERE ply < 25 UNION ALL SELECT event_id, NULL FROM evals WHERE ply >= 25")
def _(v):
    e = v("evals")
    return batching.concat_sources([e.where("ply < 25").select("event_id", "ply"), e.where("ply >= 25").select("event_id")])


TRAIN = f"WITH s AS (SELECT event_id, {u('event_id', chr(39) + 'shuffle0' + chr(39))} AS u0, {u('event_id', chr(39) + 'shuffle1' + chr(39))} AS u1 FROM evals)"


@query("train_validation", "evals", TRAIN + """ SELECT 'train' AS part, event_id, CAST((row_number() OVER (ORDER BY u0, event_id) - 1) // 256 AS BIGINT) AS batch_id FROM s
UNION ALL SELECT 'validation', event_id, b FROM (SELECT event_id, CAST((row_number() OVER (ORDER BY u1, event_id) - 1) // 128 AS BIGINT) AS b FROM s) WHERE b < 7""")
def _(v):
    train, validation = batching.train_validation(v("evals"), None, "event_id", 256, 128, 1000)
    rows = [df.select(F.lit(n).alias("part"), "event_id", "batch_id") for n, df in (("train", train), ("validation", validation))]
    return rows[0].unionByName(rows[1])


SAMPLING = filters.activation_sampling_config(filters.SkipConfig(by_result=False, balance=False, soft_early=0))


@query("activation_sampling_config", "positions", f"""WITH {CHECKED}, flagged AS (SELECT *, {PLACE.replace('game_id', 'event_id')} AS p FROM kings)
SELECT event_id FROM flagged WHERE score <> 32002 AND NOT p AND {u('event_id', chr(39) + 'random' + chr(39))} >= 10 / 11.0e0 AND NOT {CAPTURE} AND fen_id NOT IN (SELECT fen_id FROM checked)""")
def _(v):
    return filters.apply_skip_config(v("positions"), SAMPLING, "event_id", game="event_id").select("event_id")


FULL = filters.SkipConfig(thin_random=1, early=3, least_material=100)


@query("apply_skip_config_to_positions", "positions", f"""WITH {CHECKED}, flagged AS (SELECT *, CAST(len(list_filter(board, lambda p: p >= 0)) AS INT) AS piece_count, {PLACE.replace('game_id', 'event_id')} AS p FROM kings),
kept AS (SELECT * FROM flagged WHERE score <> 32002 AND NOT p AND ply > 3 AND {u('event_id', chr(39) + 'random' + chr(39))} >= 0.5e0 AND NOT {CAPTURE} AND fen_id NOT IN (SELECT fen_id FROM checked)
  AND {u('event_id', chr(39) + 'result' + chr(39))} < {RESULT_PROB} AND abs({MATERIAL}) >= 100 AND NOT (ply < 20 AND {u('event_id', chr(39) + 'soft' + chr(39))} >= {SOFT})), {RATES}
SELECT event_id FROM kept JOIN rates USING (piece_count) WHERE {u('event_id', chr(39) + 'pieces' + chr(39))} < keep_rate""")
def _(v):
    """Every rule on, with board, material and piece count worked out from the FEN."""
    return filters.apply_skip_config(v("positions"), FULL, "event_id", game="event_id").select("event_id")
