"""Per player-game sums and the averages built on them.

A player's base time is constant within a game, so sums of relative times are
sums of move times over the base.  Moves are therefore aggregated *before* the
join: map-side partial aggregation shrinks the large table to one row per
player-game, and only those rows are shuffled and joined.
"""

from pyspark.sql import functions as F

from plyclock.functions import ieee_divide
from plyclock.operators.moves import KEYS, player_games, timed_moves


def move_totals(timed):
    """Count and sum of move times per player-game.

    The counts of zero and negative times decide what a division by a zero base
    gives, see ``MEAN_RELATIVE``.
    """
    return timed.groupBy(*KEYS).agg(
        F.expr("count(*) AS _moves"),
        F.expr("sum(move_time) AS _time"),
        F.expr("count_if(move_time = 0) AS _zero"),
        F.expr("count_if(move_time < 0) AS _negative"),
    )


def counted_players(info, *attributes):
    """Distinct player-games with the number of identical copies.

    Copies collapse map-side, so a game listed very often costs one row.
    """
    players = player_games(info, attributes).drop("side")
    return players.groupBy(*players.columns).agg(F.count("*").alias("_copies"))


def player_game_totals(info, moves, attributes=("outcome",), sums=None):
    """One row per player-game: attributes, clock, ``n_moves``, ``total_time``,
    ``mean_rel_time``.

    A game listed several times counts every move that often, as a join on
    single moves would.  ``sums`` may give what ``move_totals`` makes of the timed moves.
    """
    totals = move_totals(timed_moves(moves)) if sums is None else sums
    joined = counted_players(info, *attributes).join(totals, KEYS, "inner")
    return joined.selectExpr(
        *KEYS, *attributes, "base", "increment",
        "_moves * _copies AS n_moves",
        "_time * _copies AS total_time",
        f"{MEAN_RELATIVE} AS mean_rel_time",
    )


# Mean of move time over base, as if each move had been divided: over a zero base
# a zero time gives NaN, and so do times of both signs.
MEAN_RELATIVE = f"""
CASE WHEN base <> 0 THEN {ieee_divide("_time", "base")} / _moves
     WHEN isnan(_time) OR _zero > 0 OR (_negative > 0 AND _negative < _moves) THEN double('NaN')
     WHEN _negative > 0 THEN double('-Infinity')
     ELSE double('Infinity') END
"""


# Summed time over the clock a player had.
CLOCK_SHARE = ieee_divide("total_time", "base + increment * n_moves")


def outcome_values(totals, total_clock=False):
    """``(outcome, value)`` per player-game.

    By default the value is the mean relative move time.  With ``total_clock``
    it is the share of the clock used: summed time over base plus increment for
    every timed move.
    """
    value = CLOCK_SHARE if total_clock else "mean_rel_time"
    return totals.selectExpr("outcome", f"{value} AS value")


def rating_values(totals):
    """``(rating, value)``: mean relative move time per player-game."""
    return totals.selectExpr("rating", "mean_rel_time AS value")


def eligible_player_games(totals, min_moves=11):
    """Player-games with enough timed moves for a five-move list."""
    return totals.filter(F.col("n_moves") >= min_moves)
