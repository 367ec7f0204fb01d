"""Chess-specific expressions, as SQL text like those in ``numbers``."""

from plyclock.functions.numbers import strict_cast

# The score given to a forced mate, in centipawns.
MATE_SCORE = 100000.0


def clock_base(time_control, strict=True):
    """Base seconds of a ``base+increment`` time control."""
    return _clock_part(time_control, 1, "time control base", strict)


def clock_increment(time_control, strict=True):
    """Increment seconds of a ``base+increment`` time control."""
    return _clock_part(time_control, 2, "time control increment", strict)


def _clock_part(time_control, part, name, strict):
    text = f"split_part({time_control}, '+', {part})"
    return strict_cast(text, "DOUBLE", name) if strict else f"try_cast({text} AS DOUBLE)"


def outcome_code(side, result):
    """Side letter followed by the game result, such as ``w1-0``."""
    return f"concat('{side}', {result})"


def side_of_move(move_no):
    """``w`` on odd plies, ``b`` on even ones."""
    return f"CASE WHEN {move_no} % 2 = 1 THEN 'w' ELSE 'b' END"


def parse_score(text, strict=True):
    """Engine score text to centipawns, White's view.

    A mate announcement carries ``#`` and counts as a fixed large score whose
    sign is the character after it; everything else is a plain number.
    """
    plain = (
        strict_cast(text, "DOUBLE", "centipawn_score")
        if strict
        else f"try_cast({text} AS DOUBLE)"
    )
    mate = f"if(substr({text}, 2, 1) = '-', double({-MATE_SCORE}), double({MATE_SCORE}))"
    return f"CASE WHEN contains({text}, '#') THEN {mate} ELSE {plain} END"


def opponent_aware_score(score, move_no, perspective="player"):
    """Turn a White-view score into the mover's view.

    ``player``        negate on Black's (even) plies.
    ``score_parity``  negate every even score whoever moved, which reproduces
                      the published outputs.
    ``white``         leave the score alone.
    Adding zero turns a negative zero into zero.
    """
    views = {
        "player": f"({score}) * if({move_no} % 2 = 0, -1D, 1D)",
        "score_parity": f"CASE WHEN ({score}) % 2 = 0 THEN -({score}) ELSE ({score}) END",
        "white": f"({score})",
    }
    if perspective not in views:
        raise ValueError(f"unknown perspective: {perspective}")
    return f"{views[perspective]} + 0D"
