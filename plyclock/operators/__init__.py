from plyclock.operators.moves import (
    attach_times,
    join_moves_players,
    player_games,
    reconcile_times,
    relative_moves,
    timed_moves,
)
from plyclock.operators.totals import eligible_player_games, move_totals, outcome_values, player_game_totals, rating_values
from plyclock.operators.extremes import extreme_moves, list_candidates, rating_extremes, score_extremes
from plyclock.operators.stats import outcome_histogram, outcome_labels, outcome_stats, viable
from plyclock.operators.top5 import extremes_text, rank_means, rank_points, rating_bars
from plyclock.operators.fits import (
    beam_sine,
    best_sine,
    fit_line,
    fit_score_line,
    fit_sine_grid,
    line_at,
    line_grid,
    refine_sine,
    without_mates,
)
from plyclock.operators.fold import score_moves

__all__ = [
    "attach_times", "beam_sine", "best_sine", "eligible_player_games", "extreme_moves",
    "extremes_text", "fit_line", "fit_score_line", "fit_sine_grid",
    "join_moves_players", "line_at", "line_grid", "list_candidates", "move_totals", "outcome_histogram",
    "outcome_labels", "outcome_stats", "outcome_values", "player_game_totals",
    "player_games", "rank_means", "rank_points", "rating_bars",
    "rating_extremes", "rating_values", "reconcile_times", "refine_sine", "relative_moves",
    "score_extremes", "score_moves", "timed_moves", "viable", "without_mates",
]
