"""Column layouts of the input tables.

Raw files are text with a header; columns are picked by position or by header
name.  ``MOVES`` and ``GAME_INFO`` map each logical column to its default
position, and a caller may override any entry with a header name.
"""

from pyspark.sql import types as T

# Positions in the exported files (position 0 of a moves file is
# the row index and is not used).
MOVES = {
    "game_id": 1,
    "player": 2,
    "move_no": 3,
    "move": 4,
    "move_time": 13,
    "centipawn_score": 14,
}
GAME_INFO = {
    "game_id": 0,
    "white": 6,
    "black": 7,
    "result": 8,
    "white_elo": 9,
    "black_elo": 11,
    "time_control": 22,
}

# The column order of the enriched moves table.
MOVE_COLUMNS = [
    "game_id", "player", "move_no", "move", "piece", "fen", "is_check",
    "is_check_mate", "is_fifty_moves", "is_game_over",
    "captured_score_for_white", "captured_score_for_black", "move_time",
    "centipawn_score",
]

# The six outcome groups, in report order.
OUTCOME_LABELS = [
    ("w1-0", "White Wins"),
    ("b1-0", "Black Loses"),
    ("w0-1", "White Loses"),
    ("b0-1", "Black Wins"),
    ("w1/2-1/2", "White Draws"),
    ("b1/2-1/2", "Black Draws"),
]

# The first move of each side is played before the clock starts.
UNTIMED_MOVES = (1, 2)

OUTCOME_VALUES = T.StructType([
    T.StructField("outcome", T.StringType()),
    T.StructField("value", T.DoubleType()),
])
SCORE_VALUES = T.StructType([
    T.StructField("rel_time", T.DoubleType()),
    T.StructField("score", T.DoubleType()),
])
