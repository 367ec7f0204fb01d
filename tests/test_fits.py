"""Fits, statistics and histograms."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from frames import info_frame, moves_frame, same
from plyclock import operators as ops
from plyclock.functions import two_sided_p
from test_bruteforce import random_tables


def pairs_frame(spark, pairs):
    return spark.createDataFrame([(float(x), float(y)) for x, y in pairs], "x double, y double")


@pytest.fixture(scope="module")
def noisy():
    rng = random.Random(5)
    return [(x, 0.3 * x + 2 + rng.gauss(0, 20)) for x in range(60)]


def test_line_agrees_with_mllib(spark, noisy):
    fit = ops.fit_line(pairs_frame(spark, noisy), "x", "y").first()
    data = VectorAssembler(inputCols=["x"], outputCol="v").transform(pairs_frame(spark, noisy))
    model = LinearRegression(featuresCol="v", labelCol="y", solver="normal").fit(data)
    assert fit.slope == pytest.approx(model.coefficients[0], rel=1e-9)
    assert fit.intercept == pytest.approx(model.intercept, rel=1e-9)
    assert fit.std_err == pytest.approx(model.summary.coefficientStandardErrors[0], rel=1e-9)
    assert fit.p == pytest.approx(model.summary.pValues[0], rel=1e-7)
    assert fit.r ** 2 == pytest.approx(model.summary.r2, rel=1e-9)
    assert fit.n == 60


def test_line_skips_values_that_are_not_finite(spark):
    rows = [(0, 1), (1, 3), (2, 5), (3, math.inf), (4, math.nan)]
    fit = ops.fit_line(pairs_frame(spark, rows), "x", "y").first()
    assert (fit.slope, fit.intercept, fit.r, fit.n, fit.p) == (2.0, 1.0, 1.0, 3, 0.0)


def test_residuals_average_to_zero(spark, noisy):
    df = pairs_frame(spark, noisy)
    fit = ops.fit_line(df, "x", "y", p_value=False)
    fitted = [r.fitted for r in ops.line_at(fit, df, "x").collect()]
    assert sum(fitted) == pytest.approx(sum(y for _, y in noisy))
    grid = {r.x: r.fitted for r in ops.line_grid(fit, [0, 59]).collect()}
    assert grid[0.0] == pytest.approx(fit.first().intercept)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("perspective", ["player", "score_parity"])
def test_score_line_agrees_with_single_moves(spark, seed, perspective):
    info, moves = random_tables(seed)
    info_df, moves_df = info_frame(spark, info), moves_frame(spark, moves)
    single = ops.without_mates(ops.relative_moves(info_df, moves_df, (), perspective))
    a = ops.fit_line(single, "score", "rel_time").first()
    b = ops.fit_score_line(info_df, moves_df, perspective).first()
    for name in ("slope", "intercept", "r", "std_err", "p"):
        assert b[name] == pytest.approx(a[name], rel=1e-8), name
    assert a.n == b.n


def test_sine_is_found(spark):
    df = pairs_frame(spark, [(x, 0.7 * math.sin(0.03 * x)) for x in range(-200, 200)])
    best = ops.best_sine(ops.fit_sine_grid(df, "x", "y", [0, -0.03, 0.01, 0.02, 0.03])).first()
    assert (best.b, best.a) == (0.03, pytest.approx(0.7))
    assert best.rss == pytest.approx(0, abs=1e-9)


@pytest.mark.parametrize("start", [(1.0, 1.0), (0.5, 1.02)])
def test_sine_is_refined_from_a_start(spark, start):
    rng = random.Random(3)
    xs = [rng.uniform(-20, 20) for _ in range(400)]
    ys = [0.7 * math.sin(1.01 * x) + rng.gauss(0, 0.05) for x in xs]
    fit = ops.refine_sine(pairs_frame(spark, zip(xs, ys)), "x", "y", *start).first()
    assert (fit.a, fit.b, fit.n) == (pytest.approx(0.7, abs=0.02), pytest.approx(1.01, abs=2e-3), 400)
    x, y = np.array(xs), np.array(ys)
    rest = y - fit.a * np.sin(fit.b * x)
    jacobian = np.stack([np.sin(fit.b * x), fit.a * x * np.cos(fit.b * x)], axis=1)
    assert fit.rss == pytest.approx(float(rest @ rest), rel=1e-9)
    assert np.abs(jacobian.T @ rest).max() < 1e-2
    covariance = np.linalg.inv(jacobian.T @ jacobian) * fit.rss / 398
    assert [fit.var_a, fit.cov_ab, fit.var_b] == pytest.approx(
        [covariance[0, 0], covariance[0, 1], covariance[1, 1]], rel=1e-6)


def test_refinement_says_whether_it_converged(spark):
    rng = random.Random(4)
    pairs = [(x / 10, 0.7 * math.sin(0.101 * x) + rng.gauss(0, 0.05)) for x in range(-200, 200)]
    df = pairs_frame(spark, pairs)
    done = ops.refine_sine(df, "x", "y", 0.5, 1.02).first()
    cut = ops.refine_sine(df, "x", "y", 0.5, 1.02, steps=1).first()
    assert done.converged and 1 < done.iterations < 100
    assert not cut.converged and cut.iterations == 1


def tails(spark, pairs):
    table = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pairs)], "i int, t double, df double")
    shown = table.select("i", two_sided_p(F.col("t"), F.col("df")).alias("p"))
    return [r.p for r in shown.orderBy("i").collect()]


def test_p_values_have_no_seam(spark):
    for t in (0.01, 1.0, 10.0, 30.0):
        below, at, above, far = tails(spark, [(t, 1e7 - 1), (t, 1e7), (-t, 1e7 + 1), (t, 1e15)])
        assert below == pytest.approx(at, rel=1e-6) and above == pytest.approx(at, rel=1e-6)
        assert far == pytest.approx(math.erfc(t / math.sqrt(2)), rel=1e-6)
    one, two, none, sure, nan = tails(spark, [(1, 1), (2, 2), (1, 0), (-math.inf, 3), (math.nan, 3)])
    assert one == pytest.approx(0.5) and two == pytest.approx(1 - 2 / math.sqrt(6))
    assert (none, sure, nan) == (None, 0.0, None)


def test_scores_that_hardly_differ_lose_no_digits(spark):
    rng = random.Random(8)
    info = info_frame(spark, [(f"g{g}", "w", "b", "1-0", 1500, 1600, "300+0") for g in range(30)])
    rows = [(f"g{g}", "w" if n % 2 else "b", n, float(rng.randint(1, 50)), f"+{9000 + rng.random():.6f}")
            for g in range(30) for n in range(3, 40)]
    moves = moves_frame(spark, rows)
    single = ops.without_mates(ops.relative_moves(info, moves, (), "white"))
    a, b = ops.fit_line(single, "score", "rel_time").first(), ops.fit_score_line(info, moves, "white").first()
    for name in ("slope", "intercept", "r", "std_err", "p"):
        assert b[name] == pytest.approx(a[name], rel=1e-9), name


def test_beam_finds_the_minimum_in_reach(spark):
    rng = random.Random(3)
    xs = [rng.uniform(-200, 200) for _ in range(2000)]
    ys = [0.7 * math.sin(1.0123 * x) + rng.gauss(0, 0.05) for x in xs]
    fit = ops.beam_sine(pairs_frame(spark, zip(xs, ys, strict=True)), "x", "y", 1.0, 0.05).first()
    x, y = np.array(xs), np.array(ys)
    rest = y - fit.a * np.sin(fit.b * x)
    assert (fit.a, fit.b, fit.n) == (pytest.approx(0.7, abs=0.01), pytest.approx(1.0123, abs=1e-4), 2000)
    assert fit.rss == pytest.approx(float(rest @ rest), rel=1e-9)
    assert abs(fit.grad_a) < 1e-8 and abs(fit.grad_b) < 1e-6
    assert abs(float(rest @ (fit.a * x * np.cos(fit.b * x)))) < 1e-5
    with pytest.raises(ValueError):
        ops.beam_sine(pairs_frame(spark, [(math.nan, 1)]), "x", "y")


def test_scratch_folder_of_the_session_is_used(spark, tmp_path):
    from plyclock.session import scratch_table

    class Named:
        """A session whose cluster names a scratch folder."""
        conf = {"spark.checkpoint.dir": str(tmp_path)}
        read = spark.read

    assert scratch_table(Named, spark.range(5)).count() == 5
    assert len(list(tmp_path.iterdir())) == 1


def values_frame(spark, rows):
    return spark.createDataFrame(rows, "outcome string, value double")


def test_stats_keep_empty_groups_and_count_nan(spark):
    rows = [("w1-0", 0.1), ("w1-0", 0.3), ("w1-0", math.nan), ("w1-0", math.inf), ("b0-1", 0.2)]
    stats = {r.outcome: r for r in ops.outcome_stats(values_frame(spark, rows)).collect()}
    assert len(stats) == 6
    win = stats["w1-0"]
    assert (win.label, win["count"]) == ("White Wins", 3)
    assert win.mean == pytest.approx(0.2) and win.std == pytest.approx(math.sqrt(0.02))
    assert stats["b0-1"].std is None
    assert stats["b1/2-1/2"]["count"] == 0 and stats["b1/2-1/2"].mean is None
    assert ops.viable(values_frame(spark, rows)).count() == 4


@pytest.mark.parametrize("high", [0.1, 1.0])
def test_histogram_agrees_with_numpy(spark, high):
    rng = random.Random(9)
    edges = np.linspace(0, high, 51)
    values = [rng.uniform(-0.2 * high, 1.2 * high) for _ in range(300)]
    values += [float(e) for e in edges] + [i * high / 100 for i in range(101)]
    values += [math.inf, math.nan]
    rows = [("w1-0", v) for v in values]
    got = {r.bin: r["count"] for r in
           ops.outcome_histogram(values_frame(spark, rows), 0.0, high, 50).collect()
           if r.outcome == "w1-0"}
    finite = [v for v in values if math.isfinite(v)]
    expected, _ = np.histogram(finite, bins=50, range=(0.0, high))
    assert [got[i] for i in range(50)] == list(expected)


def test_top5_summaries(spark):
    lists = spark.createDataFrame(
        [(1500, [1.0, 2.0, 3.0, 4.0, 5.0]), (1500, [3.0, 4.0, 5.0, 6.0, math.nan]),
         (1600, [math.nan] * 5), (None, [1.0] * 5)],
        "rating int, times array<double>")
    means = ops.rank_means(lists)
    got = {r.rating: [r[f"rank{i}"] for i in range(1, 6)] for r in means.collect()}
    assert got == {1500: [2.0, 3.0, 4.0, 5.0, 5.0], 1600: [None] * 5}
    bars = {r.rating: r.mean_time for r in ops.rating_bars(means).collect()}
    assert bars == {1500: pytest.approx(3.8), 1600: None}
    points = ops.rank_points(lists).filter("rating = 1500").orderBy("rank", "time").collect()
    assert [(p["rank"], p.time) for p in points[:2]] == [(1, 1.0), (1, 3.0)]


def test_averages_follow_from_single_moves(spark):
    info, moves = random_tables(4)
    info_df, moves_df = info_frame(spark, info[:12]), moves_frame(spark, moves)
    single = ops.relative_moves(info_df, moves_df).groupBy(
        "game_id", "player", "outcome", "base", "increment"
    ).agg(F.avg("rel_time").alias("again"), F.count("*").alias("n"))
    both = single.join(
        ops.player_game_totals(info_df, moves_df),
        ["game_id", "player", "outcome", "base", "increment"], "full_outer",
    ).collect()
    assert both and all(r.n == r.n_moves and same(r.again, r.mean_rel_time) for r in both)
