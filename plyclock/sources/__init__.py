from plyclock.sources.tables import (
    append_tables,
    read_game_info,
    read_months,
    read_moves,
    read_raw,
    typed_game_info,
    typed_moves,
)
from plyclock.sources.results import parse_extremes_text, read_extremes_text, read_pairs
from plyclock.sources.pgn import broken_games, clock_times, movetext, pgn_games, pgn_moves, read_pgn

__all__ = [
    "append_tables", "broken_games", "clock_times", "movetext", "parse_extremes_text", "pgn_games",
    "pgn_moves", "read_extremes_text", "read_game_info", "read_months",
    "read_moves", "read_pairs", "read_pgn", "read_raw", "typed_game_info",
    "typed_moves",
]
