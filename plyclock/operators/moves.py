"""Players, timed moves and their join."""

from pyspark.sql import functions as F

from plyclock.functions import (
    clock_base,
    clock_increment,
    ieee_divide,
    opponent_aware_score,
    outcome_code,
    parse_score,
)
from plyclock.schemas import UNTIMED_MOVES

KEYS = ["game_id", "player"]


def player_games(info, attributes=("outcome", "rating")):
    """Two rows per game, one for each side.

    Columns: ``game_id, player, side``, the chosen ``attributes``, ``base`` and
    ``increment``.  One scan of ``info`` yields both rows.  Only the columns the
    chosen attributes need are read and parsed.
    """
    def side(letter, name, elo):
        values = {"outcome": outcome_code(letter, "result"), "rating": elo}
        chosen = "".join(f", {values[a]} AS {a}" for a in attributes)
        return f"struct({name} AS player, '{letter}' AS side{chosen})"

    sides = f"array({side('w', 'white', 'white_elo')}, {side('b', 'black', 'black_elo')})"
    clocks = info.selectExpr(
        "game_id",
        f"{clock_base('time_control')} AS base",
        f"{clock_increment('time_control')} AS increment",
        f"{sides} AS _sides",
    )
    return clocks.selectExpr("game_id", "inline(_sides)", "base", "increment")


def timed_moves(moves, untimed=UNTIMED_MOVES):
    """Moves played on the clock: each side's first move is dropped."""
    return moves.filter(~F.col("move_no").isin(*untimed))


def join_moves_players(moves, players):
    """Every move with its player's attributes.

    The size of the smaller side decides between a broadcast and a sort-merge
    join.  Nothing downstream of the join asks for its partitioning, so a game
    that holds a large share of all moves is split by adaptive execution.
    """
    return players.join(moves, KEYS, "inner")


def relative_moves(info, moves, attributes=("outcome", "rating"), perspective=None):
    """Timed moves with ``rel_time`` = move time over base time.

    With a ``perspective``, ``score`` is added as well; see
    ``opponent_aware_score``.
    """
    timed = timed_moves(moves)
    if perspective:
        timed = with_score(timed, perspective)
    else:
        timed = timed.select(*KEYS, "move_no", "move_time")
    joined = join_moves_players(timed, player_games(info, attributes))
    return joined.selectExpr("*", f"{ieee_divide('move_time', 'base')} AS rel_time")


def with_score(moves, perspective="player"):
    """Keys, ply, time and the parsed score in the given perspective."""
    score = opponent_aware_score(parse_score("centipawn_score"), "move_no", perspective)
    return moves.selectExpr(*KEYS, "move_no", "move_time", f"{score} AS score")


def attach_times(moves, times):
    """Add extracted clock times to moves, matched on game and ply.

    Both keys are hashed, so a long game spreads over the tasks.  A move without
    a time keeps NULL.  Times taken out of movetext look small to Spark, as small as the
    text they come from, but are as many as the moves; so the join is fixed as a merge.
    """
    return moves.join(times.hint("merge"), ["game_id", "move_no"], "left")


def reconcile_times(moves, times):
    """Per game: moves, extracted times, and whether the two counts agree.

    Each side is counted before it is shuffled.
    """
    n_moves = moves.groupBy("game_id").agg(F.count("*").alias("n_moves"))
    n_times = times.groupBy("game_id").agg(F.count("*").alias("n_times"))
    both = n_moves.join(n_times, "game_id", "full_outer").select(
        "game_id",
        F.coalesce("n_moves", F.lit(0)).alias("n_moves"),
        F.coalesce("n_times", F.lit(0)).alias("n_times"),
    )
    return both.withColumn("matches", F.col("n_moves") == F.col("n_times"))
