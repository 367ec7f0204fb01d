"""Worked examples and edge values."""

import math

import pytest

from frames import info_frame, lists, moves_frame, one_game, same
from plyclock import operators as ops
from plyclock import sources
from plyclock.functions import ieee_divide, opponent_aware_score, parse_score, strict_cast


def game(spark, control, white_times, black_times=(0, 1), result="0-1", elo=1600):
    info = info_frame(spark, [("g1", "anna", "ben", result, elo, 1500, control)])
    return info, moves_frame(spark, one_game(white_times, black_times))


def test_share_of_total_clock(spark):
    # White lost, took 450 seconds for 30 timed moves in a 600+10 game.
    info, moves = game(spark, "600+10", [0] + [15] * 30)
    totals = ops.player_game_totals(info, moves, ("outcome",))
    shares = {r.outcome: r.value for r in ops.outcome_values(totals, total_clock=True).collect()}
    assert shares["w0-1"] == 0.5


def test_average_by_rating(spark):
    info, moves = game(spark, "600+0", [0, 5, 30, 20, 5])
    values = ops.rating_values(ops.player_game_totals(info, moves, ("rating",))).collect()
    assert [r.value for r in values if r.rating == 1600] == [0.025]


def test_ieee_division(spark):
    rows = [(5.0, 0.0), (-5.0, 0.0), (0.0, 0.0), (6.0, 3.0), (None, 0.0), (1.0, None),
            (math.nan, 0.0)]
    df = spark.createDataFrame(rows, "n double, d double")
    got = [r[0] for r in df.selectExpr(ieee_divide("n", "d")).collect()]
    assert same(got, [math.inf, -math.inf, math.nan, 2.0, None, None, math.nan])


def test_zero_base_times(spark):
    info, moves = game(spark, "0+12", [0, 5, 0], [0, 5, 7])
    rel = {(r.player, r.move_no): r.rel_time for r in ops.relative_moves(info, moves).collect()}
    assert rel[("anna", 3)] == math.inf and math.isnan(rel[("anna", 5)])
    mean = {r.player: r.mean_rel_time
            for r in ops.player_game_totals(info, moves, ("outcome",)).collect()}
    assert math.isnan(mean["anna"]) and mean["ben"] == math.inf


@pytest.mark.parametrize("text, value", [
    ("+35", 35.0), ("-20", -20.0), ("0", 0.0), ("#+3", 100000.0), ("#-2", -100000.0),
    ("#0", 100000.0),
])
def test_score_text(spark, text, value):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.selectExpr(parse_score("s")).first()[0] == value


def test_score_perspectives(spark):
    rows = [(35.0, 3), (35.0, 4), (-20.0, 3), (-20.0, 4), (0.0, 4), (100000.0, 3)]
    df = spark.createDataFrame(rows, "s double, n int")

    def in_view(perspective):
        column = opponent_aware_score("s", "n", perspective)
        return [r[0] for r in df.selectExpr(column).collect()]

    assert in_view("player") == [35.0, -35.0, -20.0, 20.0, 0.0, 100000.0]
    assert in_view("score_parity") == [35.0, 35.0, 20.0, 20.0, 0.0, -100000.0]
    assert in_view("white") == [r[0] for r in rows]
    assert all(math.copysign(1, x) == 1 for x in in_view("score_parity") if x == 0)
    with pytest.raises(ValueError):
        in_view("black")


def test_more_than_ten_moves_are_needed(spark):
    info, moves = game(spark, "600+0", list(range(12)), list(range(11)))
    for end in ("fastest", "slowest"):
        assert [r.player for r in ops.rating_extremes(info, moves, end).collect()] == ["anna"]
        assert [r.player for r in ops.score_extremes(info, moves, end).collect()] == ["anna"]
    totals = ops.player_game_totals(info, moves, ("rating",))
    assert [r.player for r in ops.eligible_player_games(totals).collect()] == ["anna"]


def test_list_orders(spark):
    info, moves = game(spark, "100+0", [0] + list(range(12, 0, -1)))
    fastest = ops.rating_extremes(info, moves, "fastest").first().times
    slowest = ops.rating_extremes(info, moves, "slowest").first().times
    by_score = ops.score_extremes(info, moves, "slowest").first().moves
    assert same(fastest, [0.01, 0.02, 0.03, 0.04, 0.05])
    assert same(slowest, [0.12, 0.11, 0.10, 0.09, 0.08])
    assert same([m.rel_time for m in by_score], [0.08, 0.09, 0.10, 0.11, 0.12])


def test_equal_times_go_by_ply(spark):
    info = info_frame(spark, [("g1", "anna", "ben", "1-0", 1600, 1500, "60+0")])
    moves = moves_frame(spark, [("g1", "anna", 2 * i + 1, 6.0, f"+{i}") for i in range(14)])
    fast = ops.score_extremes(info, moves, "fastest").first().moves
    slow = ops.score_extremes(info, moves, "slowest").first().moves
    assert [m.score for m in fast] == [1, 2, 3, 4, 5]
    assert [m.score for m in slow] == [9, 10, 11, 12, 13]


def test_same_name_on_both_sides(spark):
    info_rows = [("g1", "anna", "anna", "1-0", 1600, 1600, "60+0")]
    move_rows = [("g1", "anna", i, float(i), "+1") for i in range(1, 13)]
    info, moves = info_frame(spark, info_rows), moves_frame(spark, move_rows)
    got = {(r.game_id, r.player, r.rating): r.times
           for r in ops.rating_extremes(info, moves).collect()}
    assert same(list(got.values()), list(lists(info_rows, move_rows, (0, 1, 3)).values()))
    assert ops.relative_moves(info, moves).count() == 20


def test_null_names_do_not_join(spark):
    info = info_frame(spark, [("g1", None, "ben", "1-0", 1600, 1500, "60+0")])
    moves = moves_frame(spark, [("g1", None, 3, 1.0, "0"), ("g1", "ben", 4, 1.0, "0")])
    assert [r.player for r in ops.relative_moves(info, moves).collect()] == ["ben"]
    assert [r.player for r in ops.player_game_totals(info, moves).collect()] == ["ben"]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_bad_values_fail(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        for bad in ("x", None, ""):
            df = spark.createDataFrame([(bad,)], "v string")
            with pytest.raises(Exception, match="bad value for v"):
                df.selectExpr(strict_cast("v", "int", "v")).collect()
        for control in ("600", "600+", "a+b"):
            info, moves = game(spark, control, [0, 1, 2])
            with pytest.raises(Exception, match="time control"):
                ops.relative_moves(info, moves).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_unused_columns_are_not_parsed(spark):
    raw = spark.createDataFrame(
        [("g1", "anna", "ben", "1-0", "unrated", "1500", "60+0")],
        "game_id string, white string, black string, result string, white_elo string, "
        "black_elo string, time_control string",
    )
    info = sources.typed_game_info(raw)
    moves = moves_frame(spark, [("g1", "anna", 3, 6.0, "0")])
    assert ops.player_game_totals(info, moves, ("outcome",)).first().mean_rel_time == 0.1
    with pytest.raises(Exception, match="white_elo"):
        ops.player_game_totals(info, moves, ("rating",)).collect()


def test_quarantine(spark):
    raw = spark.createDataFrame(
        [("g1", "anna", "3", "1.5", "+3"), ("g1", "anna", "x", "1.5", "+3"),
         ("g1", "anna", "5", None, "+3"), ("g1", "anna", "7", "2", "?"),
         ("g1", "anna", "9", "2", "#-1")],
        "game_id string, player string, move_no string, move_time string, centipawn_score string",
    )
    good, bad = sources.typed_moves(raw, on_bad="quarantine")
    assert [r.move_no for r in good.orderBy("move_no").collect()] == [3, 9]
    assert dict(good.dtypes)["move_time"] == "double"
    assert bad.count() == 3 and bad.columns == raw.columns
    good, bad = sources.typed_moves(raw, "quarantine", need=("move_no", "move_time"))
    assert [r.move_no for r in good.orderBy("move_no").collect()] == [3, 7, 9] and bad.count() == 2
    info = info_frame(spark, [("g1", "anna", "ben", "1-0", 1600, 1500, "10+0")])
    assert ops.player_game_totals(info, good, ("outcome",)).first().n_moves == 3
    with pytest.raises(ValueError):
        sources.typed_moves(raw, on_bad="ignore")
    with pytest.raises(ValueError):
        sources.typed_moves(raw, "quarantine", need=("player",))


def test_negative_base_is_refused_for_lists(spark):
    info, moves = game(spark, "-60+0", list(range(13)))
    with pytest.raises(Exception, match="negative base time"):
        ops.rating_extremes(info, moves).collect()
