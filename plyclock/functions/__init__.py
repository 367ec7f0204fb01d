from plyclock.functions.chess import (
    clock_base,
    clock_increment,
    opponent_aware_score,
    outcome_code,
    parse_score,
    side_of_move,
)
from plyclock.functions.numbers import ieee_divide, is_finite, nan_to_null, strict_cast
from plyclock.functions.ttest import two_sided_p

__all__ = [
    "clock_base", "clock_increment", "ieee_divide", "is_finite", "nan_to_null",
    "opponent_aware_score", "outcome_code", "parse_score", "side_of_move",
    "strict_cast", "two_sided_p",
]
