"""Queries against DuckDB on the small tables, and golden values."""

import duckdb
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rookery.functions import board as B
from rookery.functions import evalmath as M
from rookery.operators import activations, batching, features, filters, ratings, scoring
from rookery.plans.queries import ORACLES, QUERIES
from rookery.sources import text

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FENS = [
    "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1",
    "r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R b KQkq - 0 1",
    "8/8/4k3/8/3P4/3K4/8/8 w - - 4 60",
    "rnb1kbnr/pppp1ppp/8/4p3/6Pq/5P2/PPPPP2P/RNBQKBNR w KQkq - 1 3",
]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    cols = sorted(got.columns)
    floats = [c for c in cols if pd.api.types.is_float_dtype(got[c]) or pd.api.types.is_float_dtype(want[c])]
    # what counts is the value: nulls and zeros of either sign are brought to one form, and rows paired by their exact columns first
    def plain(df):
        df = df[cols].copy()
        for c in floats:
            df[c] = df[c].astype(float) + 0.0
        text = df.astype(object).where(df.notna(), None).astype(str)
        for c in floats:
            text[c] = df[c].map(lambda x: f"{x:.5f}".replace("-0.00000", "0.00000"))
        order = text.sort_values([c for c in cols if c not in floats] + floats).index
        return df.astype(object).where(df.notna(), None).loc[order].reset_index(drop=True)

    a, b = plain(got), plain(want)
    for c in cols:
        if c in floats:
            assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=0, atol=1e-9, equal_nan=True), c
        else:
            assert a[c].astype(str).tolist() == b[c].astype(str).tolist(), c


@pytest.fixture(scope="module")
def positions(spark):
    return B.parse_fen(spark.createDataFrame(list(enumerate(FENS)), "row_id int, fen string")).cache()


def sums(df):
    return {(r.row_id, r.perspective): (r.n, r.s) for r in df.groupBy("row_id", "perspective").agg(F.count(F.lit(1)).alias("n"), F.sum("feature").alias("s")).collect()}


def test_feature_goldens(positions):
    assert sums(features.halfka_features(positions)) == {(0, 0): (32, 769264), (0, 1): (32, 769264), (1, 0): (32, 769248), (1, 1): (32, 769280), (2, 0): (3, 54427), (2, 1): (3, 54498), (3, 0): (32, 769244), (3, 1): (32, 769292)}
    assert sums(features.threat_features(positions)) == {(0, 0): (28, 715304), (0, 1): (28, 715304), (1, 0): (38, 906567), (1, 1): (38, 921434), (3, 0): (25, 569427), (3, 1): (25, 705276)}
    assert sums(features.pawn_pair_features(positions)) == {(0, 0): (36, 121246), (0, 1): (36, 121246), (1, 0): (36, 106782), (1, 1): (36, 111661), (3, 0): (36, 117560), (3, 1): (36, 114901)}
    assert [r.row_id for r in features.in_check(positions).collect()] == [3]


def test_colour_flip_swaps_perspectives(spark, positions):
    flipped = [" ".join(["/".join(reversed(f.split()[0].split("/"))).swapcase(), "b" if f.split()[1] == "w" else "w", *f.split()[2:]]) for f in FENS]
    other = B.parse_fen(spark.createDataFrame(list(enumerate(flipped)), "row_id int, fen string"))
    for fn in (features.halfka_features, features.threat_features, features.pawn_pair_features):
        a, b = sums(fn(positions)), sums(fn(other))
        assert a == {(i, 1 - p): v for (i, p), v in b.items()}


def test_features_are_in_bounds_and_unknown_names_fail(positions):
    total = sum(n for _, _, n, _ in features.feature_layout("Full_Threats+PP_3Wide+HalfKAv2_hm"))
    r = features.compose_features(positions).agg(F.min("feature"), F.max("feature")).first()
    assert total == 88944 and 0 <= r[0] and r[1] < total
    with pytest.raises(ValueError):
        features.feature_layout("HalfKP")


def test_formula_goldens(spark):
    rows = spark.createDataFrame([(0, 0), (208, 32), (-600, 80), (1200, 240), (1200, 300)], "score int, ply int")
    got = [tuple(round(x, 6) for x in r.p) for r in rows.select(M.wdl_prob(F.col("score"), F.col("ply")).alias("p")).collect()]
    assert got == [(0.109611, 0.780777, 0.109611), (0.381694, 0.602738, 0.015568), (0.000182, 0.02295, 0.976868), (0.995638, 0.00427, 0.000093), (0.995638, 0.00427, 0.000093)]
    mates = spark.createDataFrame([(31754,), (31755,), (31990,), (-32000,)], "s int").select(F.round(M.remap_mate_score(F.col("s")), 6)).collect()
    assert [r[0] for r in mates] == [31754, 4000.0, 4787.497617, -8000]
    e = spark.createDataFrame([(0,), (100,), (-500,)], "s int").select(F.round(M.expected_score(F.col("s"), 280, 353), 6)).collect()
    assert [r[0] for r in e] == [0.5, 0.560521, 0.223968]
    x = spark.createDataFrame([(0.0,), (0.25,), (0.5,), (0.64,)], "x double").select(F.round(M.elo(F.col("x")), 3)).collect()
    assert [r[0] for r in x] == [-1199.826, -190.849, 0.0, 99.951]
    assert [round(p, 4) for p in filters.soft_early_rates(filters.SkipConfig())] == [0.1, 0.1083, 0.1167, 0.125, 0.1333, 0.1417, 0.15, 0.175, 0.2, 0.225, 0.25, 0.3125, 0.375, 0.4375, 0.5, 0.5625, 0.625, 0.6875, 0.75, 0.875, 1.0]
    t = {r.piece_count: r for r in filters.piece_count_targets(spark).collect()}
    assert [round(t[i].w, 5) for i in (4, 8, 12, 16, 19, 24, 28, 32)] == [0.1875, 0.4, 0.725, 1, 1.05493, 1, 0.89062, 0.75] and t[0].total == pytest.approx(23.0015625)


def test_filters_do_not_depend_on_partitions(spark, sf):
    from rookery.plans.registry import view

    e = view(spark, sf, "evals")
    cfg = filters.SkipConfig(quiet=False, thin_random=1)
    one = {r.event_id for r in filters.apply_skip_config(e.repartition(1), cfg, "event_id").collect()}
    assert one == {r.event_id for r in filters.apply_skip_config(e.repartition(7), cfg, "event_id").collect()}
    off = filters.SkipConfig(quiet=False, by_result=False, soft_early=0, least_material=500)
    assert filters.apply_skip_config(e, off, "event_id").count() == e.count()
    assert filters.activation_sampling_config(off).thin_random == 10 and filters.activation_sampling_config(off).quiet


def test_sparse_linear_equals_dense(spark):
    rng = np.random.default_rng(0)
    idx, w, b = rng.integers(-1, 10, (16, 32)), rng.standard_normal((10, 12)), rng.standard_normal(12)
    want = np.array([w[r[r >= 0]].sum(axis=0) + b for r in idx])
    f = spark.createDataFrame([(i, int(x)) for i, r in enumerate(idx) for x in r], "row_id int, feature int")
    wt = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(10) for j in range(12)], "feature int, out_idx int, w double")
    bias = spark.createDataFrame([(j, float(x)) for j, x in enumerate(b)], "out_idx int, b double")
    got = np.zeros((16, 12))
    for r in scoring.sparse_linear(f, wt, f, bias).collect():
        got[r.row_id, r.out_idx] = r.value
    assert np.allclose(got, want)
    packed = f.groupBy("row_id").agg(F.collect_list("feature").alias("features"))
    for r in scoring.sparse_linear_matrix(packed, w, b).collect():
        assert np.allclose(r["values"], want[r.row_id])


def made_vectors(spark, inputs, width):
    """(feature, values) worked out from the feature alone, and the same as a function."""
    value = lambda f: (((np.asarray(f)[:, None] * 7919 + np.arange(width) * 104_729) % 4001 - 2000) / 16_000).astype(np.float32)

    def run(batches):
        for b in batches:
            f = np.asarray(b.column("id"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1) * width, pa.int32()), pa.array(value(f).reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column("id"), lists], ["feature", "values"])

    return spark.range(0, inputs, 1, 16).mapInArrow(run, "feature long, values array<float>"), value


def test_products_in_blocks_of_the_default_net(spark):
    """88 944 inputs to 1024 outputs, more entries than are sent to tasks: sums and scores equal the dense ones, however rows and outputs are cut."""
    inputs, width, buckets, n = 88_944, 1024, 8, 60
    assert inputs * width > scoring.MATRIX_ENTRIES
    rng = np.random.default_rng(4)
    vectors, value = made_vectors(spark, inputs, width)
    sides = [[[int(x) for x in rng.integers(0, inputs, rng.integers(0, 120))] + [-1] * 3 for _ in range(n)] for _ in range(2)]
    sides[0][0], sides[1][1] = [], None
    bias = rng.random(width)
    rows = spark.createDataFrame([(i, a, b, float(i % 2), i % buckets) for i, (a, b) in enumerate(zip(*sides, strict=True))], "row_id long, white array<int>, black array<int>, us double, bucket int")
    dense = [np.array([value([x for x in xs or [] if x >= 0]).sum(axis=0, dtype=float) for xs in side]) for side in sides]
    got = {r.row_id: r["values"] for r in scoring.sparse_linear_blocks(rows, vectors, width, bias, features="white", block=300, block_rows=25).collect()}
    assert len(got) == n and all(np.allclose(got[i], dense[0][i] + bias, atol=1e-9) for i in range(n))
    stack = lambda *shape: rng.uniform(-0.4, 0.4, shape)
    head = scoring.NetMatrices(np.zeros((0, width)), stack(inputs, buckets), bias - 0.5, stack(buckets, width, 17), stack(buckets, 17), stack(buckets, 34, 32), stack(buckets, 32), stack(buckets, 98, 1), stack(buckets, 1))
    used = sorted({x for side in sides for xs in side for x in xs or [] if x >= 0})
    place = {x: k for k, x in enumerate(used)}
    renamed = [pa.array([[place.get(x, -1) for x in xs or []] for xs in side], pa.list_(pa.int64())) for side in sides]
    us, bucket = np.arange(n) % 2 * 1.0, np.arange(n) % buckets
    for quantize in (False, True):
        whole = replace(head, ft=value(used).astype(float), psqt=head.psqt[used])
        want = (whole.quantized() if quantize else whole).scores(*renamed, us, bucket, quantize)
        scores = {r.row_id: r.score for r in scoring.score_rows_blocks(rows, vectors, head, quantize, block=256, block_rows=25).collect()}
        assert np.allclose([scores[i] for i in range(n)], want, atol=1e-6)
    with pytest.raises(ValueError, match="score_rows_blocks"):
        scoring.score_rows(rows, replace(head, ft=np.lib.stride_tricks.as_strided(np.zeros(1), (inputs, width), (0, 0))))


def test_weight_vectors_fill_up_with_zeros(spark):
    w = spark.createDataFrame([(3, 0, 1.5), (3, 4, -2.0), (7, 2, 0.25)], "feature int, out_idx int, w double")
    assert {r.feature: r["values"] for r in scoring.weight_vectors(w, 5).collect()} == {3: [1.5, 0, 0, 0, -2.0], 7: [0, 0, 0.25, 0, 0]}
    rows = spark.createDataFrame([(1, [3, 7, 7, -1, 99]), (2, None)], "row_id long, features array<int>")
    got = {r.row_id: r["values"] for r in scoring.sparse_linear_blocks(rows, scoring.weight_vectors(w, 5), 5, block=2).collect()}
    assert got == {1: [1.5, 0, 0.5, 0, -2.0], 2: [0] * 5}
    none = scoring.sparse_linear_blocks(rows, scoring.weight_vectors(w.limit(0), 5), 5, block=2)
    assert {tuple(r["values"]) for r in none.collect()} == {(0,) * 5}


def test_features_of_odd_boards(spark):
    """Rows without a FEN or a king, and one board in every orientation by plain loops."""
    rows = spark.createDataFrame([(0, None), (1, "8/8/8/8/8/8/8/K7 w - - 0 1"), (2, "8/8/8/8/8/8/8/8 w - - 0 1")], "row_id int, fen string")
    got = features.feature_arrays(B.parse_fen(rows), keep=["row_id"]).collect()
    assert [(r.row_id, r.white, r.black) for r in got] == [(0, [], []), (1, [got[1].white[0]], []), (2, [], [])] and len(got[1].white) == 1
    with pytest.raises(ValueError, match="a column or a kernel"):
        features.register_feature("Both", 1, 1)


def test_permutation_raises_the_zero_rate(spark):
    rng = np.random.default_rng(1)
    z = rng.random((200, 16)) < np.where(np.arange(16) % 4 == 0, 0.9, 0.1)
    acts = spark.createDataFrame([(i, n, bool(z[i, n])) for i in range(200) for n in range(16)], "sample_id int, neuron int, is_zero boolean").cache()
    perm = activations.find_permutation(acts, 16)
    assert sorted(perm) == list(range(16))
    before, after = (activations.zero_block_rate(a).first().rate for a in (acts, activations.apply_permutation(acts, perm)))
    assert after > before + 0.1

    def rounds(order):
        """Greedy rounds of swaps alone, stated plainly."""
        while True:
            y = z[:, order]
            full = y.reshape(len(y), -1, 4).all(axis=2).sum(axis=0)
            gains = {}
            for i in range(16):
                for j in range(i + 1, 16):
                    if i // 4 != j // 4:
                        w = y.copy()
                        w[:, [i, j]] = w[:, [j, i]]
                        both = w.reshape(len(w), -1, 4).all(axis=2).sum(axis=0)
                        gains[i, j] = int(both[i // 4] + both[j // 4] - full[i // 4] - full[j // 4])
            used, order, moved = set(), list(order), False
            for (i, j), g in sorted(gains.items(), key=lambda x: (-x[1], x[0])):
                if g > 0 and not {i // 4, j // 4} & used:
                    order[i], order[j], moved = order[j], order[i], True
                    used |= {i // 4, j // 4}
            if not moved:
                return order

    swapped = rounds(list(range(16)))
    rate = lambda order: z[:, order].reshape(200, -1, 4).all(axis=2).mean()
    assert rate(perm) >= rate(swapped) > rate(range(16))
    # rotations: of each three blocks the best, found by trying all
    g = rng.integers(-5, 6, (12, 12)).astype(float)
    g = np.minimum(g, -g.T)  # no swap gains
    of = np.arange(12) // 4
    best = max((g[i, j] + g[j, k] + g[k, i], -i, -j, -k) for i in range(4) for j in range(4, 12) for k in range(4, 12) if of[j] != of[k])
    assert activations._swaps(g, 4) == []
    assert activations._rotations(g, 4) == ([tuple(-x for x in best[1:])] if best[0] > 0 else [])


def test_permutation_of_a_wide_layer(spark):
    """512 neurons: gains by bitmaps equal those by products of matrices, over several chunks, and rounds don't lose zero blocks."""
    n, samples = 512, 3000
    rng = np.random.default_rng(2)
    z = rng.random((samples, n)) < rng.random(n) * (0.5 + 0.5 * (np.arange(samples)[:, None] % 2))
    acts = spark.range(samples).selectExpr("id AS sample_id", f"explode(sequence(0, {n - 1})) AS neuron")
    zs = {i: z[i].tolist() for i in range(samples)}
    rows = spark.createDataFrame(list(zs.items()), "sample_id long, zs array<boolean>")
    acts = acts.join(rows, "sample_id").select("sample_id", "neuron", F.get("zs", F.col("neuron")).alias("is_zero")).where("is_zero OR neuron % 3 > 0")
    packed = activations.packed_activations(acts, n, chunk=500)
    assert packed.count() > 2
    order = rng.permutation(n).tolist()
    got = np.array([r.js for r in activations._counts(packed, order, 4).orderBy("i").collect()])
    y = z[:, order].astype(float)
    rest = (np.repeat(y.reshape(samples, -1, 4).sum(axis=2), 4, axis=1) - y == 3).astype(float)
    assert (got == (y.T @ rest).astype(int)).all()
    rates = [z[:, p].reshape(samples, -1, 4).all(axis=2).mean() for p in (list(range(n)), *activations.permutation_rounds(acts, n, rounds=4))]
    assert len(rates) == 5 and all(a < b for a, b in zip(rates, rates[1:], strict=False))
    with pytest.raises(Exception, match="in a layer of"):
        activations.packed_activations(acts, 256)


def test_batches_and_validation(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    rows = batching.assign_batches(df, "k", 64).groupBy("batch_id").count().collect()
    assert sorted(r["count"] for r in rows) == [1000 - 15 * 64] + [64] * 15
    train, val = batching.train_validation(df, None, "k", 64, 32, 100)
    assert val.count() == 96 and batching.train_validation(df, None, "k", 64, 32, 0)[1] is None
    assert batching.batches_per_epoch(100, 16384) == 1


def test_own_feature_set(spark, positions):
    """A registered set takes part in compositions under its name, with its offset."""
    features.register_feature("Kings", 128, 2, lambda p: F.array(F.col("wk"), F.col("bk") + 64))
    try:
        rows = features.compose_features(positions, "HalfKAv2_hm+Kings").where("feature >= 24576").collect()
        assert {(r.row_id, r.feature - 24576) for r in rows if r.perspective == 0} == {(0, 4), (0, 124), (1, 4), (1, 124), (2, 19), (2, 108), (3, 4), (3, 124)}
        packed = features.pack_features(positions, "Kings").where("row_id = 2 AND perspective = 1").first()
        assert packed.features == [19, 108] and packed.n_active == 2
    finally:
        del features.REGISTRY["Kings"]


def test_skip_rules_come_from_the_position(spark, positions):
    """The rules of the first example in the README: worked out from the FEN, and an error where they can't be."""
    rows = positions.select("row_id", "fen").withColumns({"score": F.lit(10), "ply": F.lit(40), "result": F.lit(0), "game_id": F.col("row_id"), "move": F.struct(F.lit(12).alias("from"), F.lit(28).alias("to"))})
    cfg = filters.SkipConfig(by_result=False, soft_early=0, balance=False)
    assert sorted(r.row_id for r in filters.apply_skip_config(rows, cfg, ["game_id", "ply"]).collect()) == [0, 1, 2]  # 3 is in check
    even = filters.SkipConfig(by_result=False, soft_early=0, balance=False, quiet=False, early=0, least_material=100)
    assert sorted(r.row_id for r in filters.apply_skip_config(rows, even, "row_id").collect()) == [2]
    assert filters.apply_skip_config(rows, filters.SkipConfig(), "row_id").columns == rows.columns
    odd = rows.withColumns({"board": F.lit("mine"), "rest": F.lit(7), "piece_count": F.lit(32)})  # own columns with clashing names stay
    assert {(r.board, r.rest, r.piece_count) for r in filters.apply_skip_config(odd, cfg, "row_id").collect()} == {("mine", 7, 32)}
    for bare in (rows.drop("fen"), rows.drop("move")):
        with pytest.raises(ValueError):
            filters.apply_skip_config(bare, cfg, "row_id")


def test_fit_and_jitter(spark):
    """The fit against brute force over k, and the jitter's spread."""
    from rookery.operators.fitting import fit_sigmoid_scale

    perf = spark.createDataFrame([(b, float(1 / (1 + np.exp(-b / 300)) + 0.01 * (b % 3)), 50 + b % 7) for b in range(-800, 801, 16)], "bucket int, mean double, n int")
    k, inverse = fit_sigmoid_scale(perf)
    x, m, n = (np.array([r[i] for r in perf.collect()], float) for i in range(3))
    cost = lambda c: (n**2 * (m - 1 / (1 + np.exp(-x * c))) ** 2).sum()
    grid = np.linspace(0.8, 1.2, 4001) * k
    jitter = lambda df: df.select("id", M.lambda_jitter(F.lit(0.5), 0.1, "id").alias("j"), M.lambda_jitter(F.lit(0.5), 0.1, "id", scale=F.lit(0.0)).alias("still"), M.lambda_jitter(F.lit(0.99), 1.0, "id").alias("cut"), M.lambda_jitter(F.lit(0.5), 0.0, "id", batch=F.lit(0.2)).alias("whole")).orderBy("id").toPandas()
    got = jitter(spark.range(2000))
    assert abs(got.j.mean() - 0.5) < 0.01 and abs(got.j.std() - 0.1) < 0.01 and (got.still == 0.5).all() and got.cut.between(0, 1).all() and got.cut.max() == 1 and np.allclose(got.whole, 0.7)
    assert got.equals(jitter(spark.range(0, 2000, 1, 1))) and got.equals(jitter(spark.range(2000).repartition(7)))
    assert abs(grid[np.argmin([cost(c) for c in grid])] - k) < 2e-4 * k and inverse == pytest.approx(1 / k)


def test_islands_are_carried_over_ranges(spark):
    """One partition value in many tasks: games and last known scores as plain loops give them, for any number of ranges."""
    from rookery.operators import sequence

    rng = np.random.default_rng(11)
    rows, at = [], 0
    for g in range(60):
        for ply in range(rng.integers(1, 90) if g else 900):
            rows.append((None if g == 59 else 0 if g < 50 else 1, at, ply, (-1) ** ply * (g % 3 - 1), int(rng.choice((0, 0, 32002, 50, 500, -700))), g))
            at += 1
    df = spark.createDataFrame(rows, "part int, at long, ply int, result int, score int, game int").repartition(7)
    want, number, before = {}, {}, {}
    for part, at, ply, result, *_ in rows:
        last = before.get(part)
        number[part] = number.get(part, 0) + (not (last and result == -last[0] and ply == last[1] + 1))
        before[part] = (result, ply)
        want[at] = number[part]
    kept, known = set(), {}
    for _, at, _, result, score, game in rows:
        if not (score == 0 and result and abs(known.get(game, 0)) > 100):
            kept.add(at)
        if score not in (0, 32002):
            known[game] = score
    for ranges in (1, 9, 40):
        told = sequence.assign_game_id(df, "part", ["at"], ranges=ranges)
        assert {r.at: r.game_no for r in told.collect()} == want and told.columns == [*df.columns, "game_no"]
        assert {r.at for r in filters.drop_placeholder_zero(df, "game", "ply", ranges=ranges).collect()} == kept
    assert sequence.in_ranges(df.where("part = 0"), ["part", "at"], 9).select("__part").distinct().count() == 9
    every = [r.average for r in sequence.decayed_average(df, "part", ["at"], "score", 0.9, F.lit(0)).orderBy("part").collect()]
    assert np.allclose(every, [r.average for r in sequence.decayed_average(df, "part", ["at"], "score", 0.9).orderBy("part").collect()])


def test_series_are_carried_from_fold_to_fold(spark, monkeypatch):
    """Over several levels of folds, against a loop; and the jitter's spread in the long run."""
    from rookery.operators import sequence

    jitter = np.array([r.jitter for r in sequence.batch_jitter(spark.range(5000).withColumnRenamed("id", "b"), "b", 0.1, 0.8).orderBy("b").collect()])
    assert abs(jitter[50:].std() - 0.1) < 0.01 and abs(np.corrcoef(jitter[:-1], jitter[1:])[0, 1] - 0.8) < 0.05
    monkeypatch.setattr(sequence, "FOLD", 4)
    values = np.random.default_rng(8).normal(size=150)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(values)], "k long, x double").repartition(5)
    for decay in (0.0, 0.5, 0.99, 1.0):
        want, last = [], 0.0
        for x in values:
            last = last * decay + x
            want.append(last)
        got = [r.series for r in sequence.decayed_series(df, "k", "x", decay).orderBy("k").collect()]
        assert np.allclose(got, want, rtol=0, atol=1e-12)
    assert sequence.decayed_series(df.limit(0), "k", "x", 0.5).count() == 0


def test_exact_quantiles_narrow_ranges(spark):
    from rookery.operators.analytics import exact_quantiles

    rng = np.random.default_rng(9)
    shares = (0.0, 0.001, 0.25, 0.5, 0.6827, 0.9973, 1.0)
    for x in (rng.normal(size=3000), np.repeat([1.0, 2.0, 1e9], [500, 1, 499]), np.full(10, -3.5), rng.lognormal(0, 30, 2000), np.array([7.0]), np.array([-1.7e308, 0.0, 5e-324, 1.7e308])):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
        for cells in (3, 4096):
            assert np.allclose(exact_quantiles(df, "x", shares, cells), np.quantile(x / 4, shares) * 4, rtol=1e-12), cells
    assert exact_quantiles(df.limit(0), "x", (0.5,)) == [None]


def test_shards_keep_the_shuffled_order(spark, tmp_path):
    """A file cut anywhere: files by name are the order, the manifest counts them, and a trainer goes on from any row."""
    path = str(tmp_path / "ordered")
    rows = batching.shuffle_rows(spark.range(5000).selectExpr("id", "id % 3 = 0 AS x", "cast(if(id < 4000, 0, id % 2 + 1) as int) AS shard"), "id")
    manifest = batching.write_training_shards(rows, path, ["shuffle_key", "id"], file_rows=300)
    parts = manifest.orderBy("shard", "file").collect()
    assert sum(p.n_rows for p in parts) == 5000 and max(p.n_rows for p in parts) <= 300 and len([p for p in parts if p.shard == 0]) > 10
    for k in range(3):
        want = [r.id for r in rows.where(F.col("shard") == k).orderBy("shuffle_key", "id").collect()]
        for start in (0, 1, 299, 437, len(want), len(want) + 5):
            got = batching.read_shard(spark, path, k, start).orderBy("row_no").collect()
            assert [r.id for r in got] == want[start:] and [r.row_no for r in got] == list(range(min(start, len(want)), len(want)))
    assert spark.read.parquet(path).count() == 5000


def test_any_part_of_a_path_matches_a_rating(spark):
    nets = spark.createDataFrame([("exp/run_1/nn-epoch19.nnue",), ("exp/run_12/nn-epoch19.nnue",), ("other/x.nnue",), ("a",)], "path string")
    rated = spark.createDataFrame([("run_1/nn-epoch19.nnue", 1.0, 9.0, 1), ("n_1", 2.0, 9.0, 2), ("xp/run_12/nn", 3.0, 9.0, 3), ("", 4.0, 9.0, 4), ("x.nnue", 5.0, 9.0, 6), ("ther/x", 6.0, 9.0, 5)], "net string, elo double, elo_error double, line_no int")
    assert {r.path: r.elo for r in ratings.match_ratings(nets, rated).collect()} == {"exp/run_1/nn-epoch19.nnue": 2.0, "exp/run_12/nn-epoch19.nnue": 3.0, "other/x.nnue": 5.0, "a": -500.0}


def test_files(spark, tmp_path):
    games = spark.createDataFrame([("run_1/nn-epoch19.nnue", "master", "1-0"), ("master", "run_1/nn-epoch19.nnue", "1/2-1/2"), ("master", "run_2/nn-epoch39.nnue", "0-1"), ("a", "b", "*")], "white string, black string, result string")
    pgn = "".join(f'[Event "g"]\n[White "{g.white}"]\n[Black "{g.black}"]\n[Result "{g.result}"]\n\n1. e4 *\n\n' for g in games.collect())
    (tmp_path / "out.pgn").write_text("[White \"x\"]\n" + pgn)
    read = text.read_game_results(spark, str(tmp_path / "out.pgn"))
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, games.where("result <> '*'").collect()))
    table = ratings.standings(read)
    text.write_rating_table(table, str(tmp_path / "ordo"))
    back = {r.net: r for r in text.read_rating_table(spark, str(tmp_path / "ordo")).collect()}
    assert back["run_1/nn-epoch19.nnue"].epoch == 19 and back["run_2/nn-epoch39.nnue"].elo == pytest.approx(1199.8)
    for _ in range(2):
        text.append_games(read, str(tmp_path / "games"), 1)
    text.append_games(read, str(tmp_path / "games"), 2)
    assert spark.read.parquet(str(tmp_path / "games")).count() == 6
    (tmp_path / "m1.csv").write_text("epoch,step,loss\n0,1,0.5\n0,2,nope\n")
    (tmp_path / "m2.csv").write_text("epoch,step,loss,val_loss\n1,3,0.25,0.75\n1,4,,0.5\n")
    long = text.read_metrics(spark, [str(tmp_path / "m1.csv"), str(tmp_path / "m2.csv")])
    assert sorted((r.epoch, r.step, r.name, r.value) for r in long.collect()) == [(0, 1, "loss", 0.5), (1, 3, "loss", 0.25), (1, 3, "val_loss", 0.75), (1, 4, "val_loss", 0.5)]
    for f in ("run_1/nn-epoch19.nnue", "run_1/epoch=39-step=9.ckpt", "run_1/last.ckpt", "run_1/log.txt"):
        (tmp_path / "exp" / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "exp" / f).write_text("x")
    found = {(r.kind, r.run_id, r.epoch) for r in text.scan_artifacts(spark, str(tmp_path / "exp")).collect()}
    assert found == {("nnue", 1, 19), ("ckpt", 1, 39), ("ckpt", 1, None)}
    (tmp_path / "train.log").write_text("hello\nEpoch 3 (Train): 50%| 20/400 [0:1<0:2, 12.5it/s, loss=0.125]\nCUDA out of memory\n")
    rows = text.read_training_log(spark, str(tmp_path / "train.log")).collect()
    assert [(r.epoch, r.step, r.loss, r.message, r.out_of_memory) for r in rows] == [(None, None, None, "hello", False), (3, 20, 0.125, None, False), (None, None, None, "CUDA out of memory", True)]
    batching.write_training_shards(batching.assign_shard(spark.range(10).withColumnRenamed("id", "chunk_no"), 2), str(tmp_path / "shards"), ["chunk_no"])
    assert spark.read.parquet(str(tmp_path / "shards")).where("shard = 1").count() == 5


def test_start_worth_of_inputs_beyond_the_default_net(spark, tmp_path):
    """A weight table of more inputs than 32 king buckets loses none."""
    spark.createDataFrame([(24_575, [0.5, 1.5]), (24_576, [0.25, 0.75]), (24_576 + 64, [1.0, 2.0])], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.in_idx: (r.start, r["mean"]) for r in QUERIES["initial_psqt"](spark, str(tmp_path)).collect()}
    assert got == {24_575: (0.0, 1.0), 24_576: (0.21, 0.5), 24_640: (-0.21, 1.5)}


def test_sums_stay_one_vector_a_row(spark, monkeypatch):
    """Vectors equal the dense product, by matrix and by blocks; only features in use come to the driver, however long the weight table."""
    f = spark.createDataFrame([("a", 1), ("a", 1), ("a", 3), ("b", -1), ("c", 99), ("d", None)], "row_id string, feature int")
    w = spark.range(5000).select(F.col("id").alias("feature"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("out_idx")).withColumn("w", F.col("feature") * 10.5 + F.col("out_idx"))
    used = scoring.weights_in_use(f, w)
    assert sorted(r.feature for r in used.select("feature").distinct().collect()) == [1, 3, 99]
    assert scoring.weight_matrix(used).shape == (100, 4)
    value = lambda *xs: [sum(x * 10.5 + o for x in xs) for o in range(4)]
    want = {"a": value(1, 1, 3), "b": [0.0] * 4, "c": value(99), "d": [0.0] * 4}
    assert {r.row_id: r["values"] for r in scoring.linear_vectors(f, w, f).collect()} == want
    halves = scoring.pairwise_activation(spark.createDataFrame([(1, [0.5, 2.0, 0.5, -1.0])], "row_id int, values array<double>"), 2).first()
    assert halves["values"] == [0.25, 0.0]
    numbers = f.select(F.ascii("row_id").alias("row_id"), "feature")
    monkeypatch.setattr(scoring, "MATRIX_ENTRIES", 10)
    assert {chr(r.row_id): r["values"] for r in scoring.linear_vectors(numbers, w, numbers).collect()} == want


def test_activations_shuffle_no_row_per_output(spark, sf):
    """The plans group features by row and nothing behind that."""
    for name in ("pairwise_activation", "collect_activations", "bucketed_dense", "score_positions"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        behind = plan.split("MapInArrow")[0]
        assert "MapInArrow" in plan and "Join" not in behind and "Aggregate" not in behind, name


def test_triggers_and_waves_do_not_grow_with_the_input(spark, monkeypatch):
    """Files are taken in a few triggers however many there are; waves follow the key of most rows, and rows without any are none."""
    from types import SimpleNamespace

    from rookery.plans import streams as plans

    assert plans.per_trigger(1000, 2) == 125 and plans.per_trigger(4, 2) == 2
    starts = []
    monkeypatch.setattr(plans, "put_to", lambda stream, root, mode: starts.append(root) or spark.read.schema(stream.schema).parquet(f"{root}/in").write.mode("overwrite").parquet(f"{root}/out") or SimpleNamespace(awaitTermination=lambda: None))
    monkeypatch.setattr(plans, "WAVE_ROWS", 10)
    rows = spark.range(80).select((F.col("id") % 8).alias("k"), F.floor(F.col("id") / 8).alias("at"))
    assert plans.in_waves(rows, "waves", "k", F.col("at"), lambda s: s).count() == 80
    assert len(starts) == 3  # 8 keys of 10 rows each
    assert plans.in_waves(rows.limit(0), "waves", "k", F.col("at"), lambda s: s).count() == 0


def test_heads_and_shards_are_found_without_sorts_or_maps(spark, tmp_path):
    """Heads of metrics come by a least number, and a shard's files by a join: neither holds a file's lines nor walks a list of files per row."""
    (tmp_path / "m.csv").write_text("epoch,step,loss\n0,1,0.5\n\n0,2,0.25\n")
    long = text.read_metrics(spark, [str(tmp_path / "m.csv")])
    plan = long._jdf.queryExecution().executedPlan().toString()
    assert "min_by" not in plan and "SortMergeJoin" not in plan and long.count() == 2
    rows = spark.range(300).select("id", (F.col("id") % 2).cast("int").alias("shard"))
    batching.write_training_shards(batching.shuffle_rows(rows, "id"), str(tmp_path / "s"), ["shuffle_key", "id"], file_rows=10)
    back = batching.read_shard(spark, str(tmp_path / "s"), 1, 30)
    assert "map(" not in back._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.row_no for r in back.collect()) == list(range(30, 150))


def test_equal_boards_are_worked_out_once(spark, monkeypatch):
    from rookery.operators import board_kernel as K

    parsed = B.parse_fen(spark.createDataFrame([(i, FENS[i % 4]) for i in range(40)], "row_id int, fen string").coalesce(1))
    batch = parsed.select("row_id", "board", "wk", "bk").toArrow().combine_chunks().to_batches()[0]
    sizes = []
    half = lambda b, p: sizes.append(len(b.board)) or K.half_king(b, p)
    (out,) = K.active_features([(0, half)], ["row_id"])(iter([batch]))
    assert sizes == [4, 4]
    ones = [next(K.active_features([(0, K.half_king)], ["row_id"])(iter([batch.slice(i, 1)]))) for i in range(8)]
    assert [o.column("white").to_pylist()[0] for o in ones] == out.column("white").to_pylist()[:8]
