"""The fastest and slowest moves of each player-game.

Plan: rank the moves of a player-game by time and keep a few.  Spark limits
each group both before and after the shuffle (``WindowGroupLimit``), so what one
group sends to one task is bounded by (rows kept) x (map tasks), however many
moves the group has.  Only then are the survivors gathered into an array and
joined to the players, whose base time turns them into relative times.

Ranking before the base time is known is exact for every base >= 0.  A positive
base keeps the order.  A zero base sends non-zero times to an infinity of their
sign, which keeps their order too, and zero times to NaN, which sorts last.
Zero and non-zero times are therefore ranked separately and merged afterwards.
Keeping at least ``min_moves`` per rank also tells whether the group is large
enough, without counting all of it.
"""

from pyspark.sql import functions as F

from plyclock.functions import ieee_divide
from plyclock.operators.moves import KEYS, timed_moves, with_score
from plyclock.operators.totals import counted_players

ENDS = ("fastest", "slowest")

#: Up to so many required moves, the rank also tells whether a group has enough of them.
RANKED_MOVES = 100


def extreme_moves(moves, ends=ENDS, keep=11, extra=()):
    """Candidates for the ends of each player-game.

    Returns ``game_id, player``, one array per end and ``_seen``, the group's
    size counted up to at least ``keep``.  Array entries are
    ``(time, ply, *extra)``; ply is 0 when ``extra`` is empty, because equal
    times are then interchangeable.
    """
    # Slowest first is the same ranking with both keys negated.  NaN has no
    # negative, so its place is set by a key of its own.
    tagged = moves.selectExpr(
        *KEYS, "move_time", f"{'move_no' if extra else 0} AS _ply", *extra,
        "move_time = 0 AS _idle",
        f"explode(array{tuple(ends)}) AS _end" if len(ends) > 1 else f"'{ends[0]}' AS _end",
    )
    slow = "_end = 'slowest'"
    rank = f"""
        row_number() OVER (
            PARTITION BY {", ".join(KEYS)}, _idle, _end
            ORDER BY if({slow}, NOT isnan(move_time), isnan(move_time)),
                     if({slow}, -move_time, move_time), if({slow}, -_ply, _ply))"""
    kept = tagged.selectExpr("*", f"{rank} AS _rank").filter(f"_rank <= {keep}")
    entry = ", ".join(["move_time AS time", "_ply AS ply", *extra])
    return kept.groupBy(*KEYS).agg(
        F.expr(f"count_if(_end = '{ends[0]}') AS _seen"),
        *[F.expr(f"collect_list(CASE WHEN _end = '{e}' THEN struct({entry}) END) AS {e}")
          for e in ends],
    )


def _candidates(timed, ends, k, min_moves, extra=()):
    """Candidates for lists of ``k``, with the group's size in ``_seen``.

    A large ``min_moves`` must not drive the rank: arrays would grow with it, and
    beyond Spark's group-limit threshold the limit would leave the plan.  The sizes
    are then counted apart.  The choice rests on the parameter, not on the data.
    """
    if min_moves <= RANKED_MOVES:
        return extreme_moves(timed, ends, max(k, min_moves), extra)
    sizes = timed.groupBy(*KEYS).agg(F.count("*").alias("_seen"))
    return extreme_moves(timed, ends, k, extra).drop("_seen").join(sizes, KEYS, "inner")


def _with_base(info, candidates, ends, attributes, min_moves, k):
    """Join candidates to players and make their times relative, sorted ascending."""
    joined = counted_players(info, *attributes).join(candidates, KEYS, "inner")
    checked = "if(base < 0, double(raise_error('negative base time')), base) AS _base"
    enough = joined.filter(f"_seen * _copies >= {min_moves}").selectExpr("*", checked)
    # Each move counts once per copy of its game, and k of them are enough.
    entry = f"struct({ieee_divide('e.time', '_base')} AS rel_time, e AS move)"
    repeated = f"array_repeat({entry}, int(least(_copies, {k})))"
    return enough.selectExpr(
        *KEYS, *attributes,
        *[f"sort_array(flatten(transform({end}, e -> {repeated}))) AS {end}" for end in ends],
    )


def list_candidates(moves, ends=ENDS, perspective="player", k=5, min_moves=11):
    """Candidates from which both ``rating_extremes`` and ``score_extremes`` can be made."""
    scored = with_score(timed_moves(moves), perspective)
    return _candidates(scored, ends, k, min_moves, extra=("score",))


def rating_extremes(info, moves, end="fastest", k=5, min_moves=11, candidates=None):
    """``game_id, player, rating, times``: the ``k`` fastest relative times
    ascending, or the ``k`` slowest descending.

    ``end`` may also be a list; ``times`` is then replaced by one array per end.
    ``candidates`` may give those of ``list_candidates`` for the same numbers.
    """
    ends = (end,) if isinstance(end, str) else tuple(end)
    if candidates is None:
        candidates = _candidates(timed_moves(moves), ends, k, min_moves)
    ready = _with_base(info, candidates, ends, ("rating",), min_moves, k)

    def times(e):
        ordered = f"{e}.rel_time" if e == "fastest" else f"reverse({e}.rel_time)"
        return f"slice({ordered}, 1, {k}) AS {'times' if len(ends) == 1 else e}"

    return ready.selectExpr(*KEYS, "rating", *map(times, ends))


def score_extremes(info, moves, end="fastest", perspective="player", k=5, min_moves=11,
                   candidates=None):
    """``game_id, player, moves``: the ``k`` fastest or slowest moves as
    ``(rel_time, score)``, both ascending by time.

    Equal relative times are ordered by move time, then by ply.  The move time only
    matters over a base of zero, where all non-zero times come out as one infinity.
    ``end`` may be a list and ``candidates`` given, as above.
    """
    ends = (end,) if isinstance(end, str) else tuple(end)
    if candidates is None:
        candidates = list_candidates(moves, ends, perspective, k, min_moves)
    ready = _with_base(info, candidates, ends, (), min_moves, k)

    def pairs(e):
        chosen = f"slice({e}, 1, {k})" if e == "fastest" else (
            f"reverse(slice(reverse({e}), 1, {k}))"
        )
        shown = "struct(x.rel_time AS rel_time, x.move.score AS score)"
        return f"transform({chosen}, x -> {shown}) AS {'moves' if len(ends) == 1 else e}"

    return ready.selectExpr(*KEYS, *map(pairs, ends))
