"""Random tables, including repeated games and one very large game."""

import random

import pytest

from frames import divide, grouped, info_frame, joined, lists, moves_frame, same
from plyclock import operators as ops

CONTROLS = ["0+12", "60+0", "180+2", "600+10", "0+0"]


def random_tables(seed, games=12, longest=60):
    rng = random.Random(seed)
    info, moves = [], []
    for g in range(games):
        white, black = f"p{rng.randrange(6)}", f"p{rng.randrange(6)}"
        info.append((f"g{g}", white, black, rng.choice(["1-0", "0-1", "1/2-1/2"]),
                     rng.choice([1400, 1500]), rng.choice([1400, 1500]), rng.choice(CONTROLS)))
        for ply in range(1, rng.randrange(5, longest)):
            time = rng.choice([0.0, 0.0, 1.0, 2.5, rng.randrange(1, 30) / 4, -1.0])
            score = rng.choice(["#+3", "#-2", "0", f"+{rng.randrange(400)}", f"-{rng.randrange(400)}"])
            moves.append((f"g{g}", white if ply % 2 else black, ply, time, score))
    info += [info[0], info[0], info[1]]
    return info, moves


@pytest.fixture(scope="module", params=[1, 2])
def tables(request, spark):
    info, moves = random_tables(request.param)
    return info, moves, info_frame(spark, info), moves_frame(spark, moves).repartition(5)


def mean(values):
    return sum(values) / len(values)


def check(got, expected):
    assert set(got) == set(expected)
    for key in expected:
        assert same(got[key], expected[key]), key


@pytest.mark.parametrize("attribute, index", [("outcome", 2), ("rating", 3)])
def test_totals(tables, attribute, index):
    info, moves, info_df, moves_df = tables
    key = (0, 1, index, 4, 5)
    expected = {
        k: (len(rows), sum(r[7] for r in rows), mean([divide(r[7], r[4]) for r in rows]))
        for k, rows in grouped(joined(info, moves), key).items()
    }
    got = {
        (r.game_id, r.player, r[attribute], r.base, r.increment):
            (r.n_moves, r.total_time, r.mean_rel_time)
        for r in ops.player_game_totals(info_df, moves_df, (attribute,)).collect()
    }
    check(got, expected)


def test_shares(tables):
    info, moves, info_df, moves_df = tables
    expected = sorted(
        (k[2], repr(divide(sum(r[7] for r in rows), k[3] + k[4] * len(rows))))
        for k, rows in grouped(joined(info, moves), (0, 1, 2, 4, 5)).items()
    )
    totals = ops.player_game_totals(info_df, moves_df, ("outcome",))
    got = sorted((r.outcome, repr(r.value))
                 for r in ops.outcome_values(totals, total_clock=True).collect())
    assert got == expected


@pytest.mark.parametrize("end", ["fastest", "slowest"])
def test_rating_lists(tables, end):
    info, moves, info_df, moves_df = tables
    expected = lists(info, moves, (0, 1, 3), slow=end == "slowest")
    if end == "slowest":
        expected = {k: v[::-1] for k, v in expected.items()}
    got = {(r.game_id, r.player, r.rating): r.times
           for r in ops.rating_extremes(info_df, moves_df, end).collect()}
    check(got, expected)


@pytest.mark.parametrize("end", ["fastest", "slowest"])
def test_score_lists(tables, end):
    info, moves, info_df, moves_df = tables
    expected = lists(info, moves, (0, 1), slow=end == "slowest")
    got = {(r.game_id, r.player): [m.rel_time for m in r.moves]
           for r in ops.score_extremes(info_df, moves_df, end).collect()}
    check(got, expected)


def test_both_ends_at_once(tables):
    _, _, info_df, moves_df = tables
    for build, name in ((ops.rating_extremes, "times"), (ops.score_extremes, "moves")):
        both = build(info_df, moves_df, ("fastest", "slowest")).collect()
        for end in ("fastest", "slowest"):
            single = build(info_df, moves_df, end).collect()
            keys = [c for c in single[0].asDict() if c != name]

            def text(rows, column):
                return sorted(str([r[k] for k in keys] + [r[column]]) for r in rows)

            assert text(both, end) == text(single, name)


def test_partitioning_does_not_matter(tables):
    _, _, info_df, moves_df = tables
    results = [
        sorted(str(r) for r in ops.rating_extremes(info_df, moves_df.repartition(n)).collect())
        for n in (1, 9)
    ]
    assert results[0] == results[1]


def test_one_game_with_a_third_of_all_moves(spark):
    info, moves = random_tables(3, games=8)
    hot = [("g0", info[0][1], ply, float(ply % 97) / 4, f"+{ply % 50}")
           for ply in range(100, 6000)]
    moves += hot
    info_df, moves_df = info_frame(spark, info), moves_frame(spark, moves).repartition(7)
    for end in ("fastest", "slowest"):
        expected = lists(info, moves, (0, 1), slow=end == "slowest")
        got = {(r.game_id, r.player): [m.rel_time for m in r.moves]
               for r in ops.score_extremes(info_df, moves_df, end).collect()}
        check(got, expected)
    kept = ops.extreme_moves(ops.timed_moves(moves_df), ("fastest",))
    assert max(len(r.fastest) for r in kept.collect()) <= 22
    assert ops.relative_moves(info_df, moves_df).count() == len(joined(info, moves))
