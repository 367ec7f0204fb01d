"""Scores that are missing stay missing."""

import pytest

from plyclock import operators as ops


def test_a_move_without_a_game_stops_the_job(spark):
    moves = spark.createDataFrame(
        [("g", 1, "e4"), (None, 2, "e5")], "game_id string, move_no int, move string")
    with pytest.raises(Exception, match="without a game"):
        ops.score_moves(moves, lambda: lambda rows: [1.0] * len(rows)).collect()


def test_null_and_nan_scores(spark):
    moves = spark.createDataFrame(
        [("g", i, "e4") for i in range(3)], "game_id string, move_no int, move string")

    def new_game():
        return lambda rows: [None, float("nan"), 1.5][:len(rows)]

    got = {r.move_no: r.centipawn_score for r in ops.score_moves(moves.coalesce(1), new_game).collect()}
    assert got == {0: None, 1: None, 2: "1.5"}
