"""Small hand-made tables, and the reference semantics in plain Python.

``brute_force`` joins every single move to its player and groups afterwards,
which is the definition the operators' pre-aggregated plans must agree with.
"""

import math

INFO_SCHEMA = ("game_id string, white string, black string, result string, "
               "white_elo int, black_elo int, time_control string")
MOVES_SCHEMA = "game_id string, player string, move_no int, move_time double, centipawn_score string"


def info_frame(spark, rows):
    return spark.createDataFrame(rows, INFO_SCHEMA)


def moves_frame(spark, rows):
    return spark.createDataFrame(rows, MOVES_SCHEMA)


def one_game(times_white, times_black, game="g1", score="+10"):
    """Moves of a game from each side's times, first moves included."""
    rows = []
    for side, (name, times) in enumerate((("anna", times_white), ("ben", times_black))):
        for i, t in enumerate(times):
            rows.append((game, name, 2 * i + 1 + side, float(t), score))
    return rows


def divide(n, d):
    if d != 0:
        return n / d
    if n == 0 or math.isnan(n):
        return math.nan
    return math.inf if n > 0 else -math.inf


def joined(info, moves):
    """(game, player, outcome, rating, base, increment, ply, time, score text)."""
    out = []
    for game, white, black, result, welo, belo, control in info:
        base, increment = (float(x) for x in control.split("+"))
        for player, side, elo in ((white, "w", welo), (black, "b", belo)):
            for g, p, ply, time, score in moves:
                if g == game and p == player and ply not in (1, 2):
                    out.append((game, player, side + result, elo, base, increment, ply, time, score))
    return out


def grouped(rows, key):
    groups = {}
    for row in rows:
        groups.setdefault(tuple(row[i] for i in key), []).append(row)
    return groups


def java_order(value):
    return (1, 0.0) if math.isnan(value) else (0, value)


def lists(info, moves, key, slow=False, k=5, min_moves=11):
    """{key: the k first (or last) relative times, ascending}."""
    out = {}
    for group, rows in grouped(joined(info, moves), key).items():
        if len(rows) >= min_moves:
            times = sorted((divide(r[7], r[4]) for r in rows), key=java_order)
            out[group] = times[-k:] if slow else times[:k]
    return out


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        if math.isnan(a) or math.isnan(b):
            return math.isnan(a) and math.isnan(b)
        return a == b or math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-15)
    if isinstance(a, (list, tuple)):
        return len(a) == len(b) and all(same(x, y) for x, y in zip(a, b))
    return a == b
