"""The three batch jobs, each from a moves table and a game-info table.

    python -m plyclock.plans.jobs Rating moves_path info_path out_path

A job reads its inputs once.  Where several outputs start from the moves, the timed moves
with the columns the job needs, typed, are written once to the scratch folder and all
outputs start from there; so are the games.  What several outputs share further on is
written once as a Parquet profile in the output folder and read back.
"""

import argparse

from pyspark.sql import SparkSession

from plyclock import operators as ops
from plyclock import sinks, sources
from plyclock.operators.moves import KEYS
from plyclock.session import scratch_table

KINDS = ("Outcome", "Rating", "Score")

ENDS = ("fastest", "slowest")
LISTS = (("fastest", "FastestMoveTimes"), ("slowest", "SlowestMoveTimes"))

#: Columns of moves and games from which the outputs of a job are made.
STAGED = {
    "Outcome": ([*KEYS, "move_no", "move_time"],
                ["game_id", "white", "black", "result", "time_control"]),
    "Rating": ([*KEYS, "move_no", "move_time"],
               ["game_id", "white", "black", "white_elo", "black_elo", "time_control"]),
    "Score": ([*KEYS, "move_no", "move_time", "centipawn_score"],
              ["game_id", "white", "black", "time_control"]),
}


def staged(spark, kinds, moves, info):
    """The inputs of jobs, read once: ``(moves, info)`` from the scratch folder."""
    if kinds == {"Outcome"}:
        return moves, info
    of_moves, of_info = (list(dict.fromkeys(c for kind in KINDS if kind in kinds for c in STAGED[kind][i]))
                         for i in range(2))
    return (scratch_table(spark, ops.timed_moves(moves).select(*of_moves)),
            scratch_table(spark, info.select(*of_info)))


def run_job(spark, kind, moves, info, out, text=False, perspective="player",
            mode="errorifexists"):
    """Run one job and return {output name: path}.

    ``out`` is a folder prefix; the job's kind is part of every output's name, so
    jobs may share a prefix.  ``text`` writes the ``key,value`` and list text
    forms instead of Parquet.
    """
    return run_jobs(spark, (kind,), moves, info, out, text, perspective, mode)[kind]


def run_jobs(spark, kinds, moves, info, out, text=False, perspective="player",
             mode="errorifexists"):
    """Run several jobs on the same tables and return {kind: {output name: path}}.

    The outputs are those of ``run_job`` for each kind.  The inputs are read once for
    all of them, and what two kinds share is made once: the sums per player-game, the
    moves joined to their players, and the candidates of the lists.
    """
    for kind in kinds:
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}, not {kind!r}")
    moves, info = staged(spark, set(kinds), moves, info)
    both, sums, joined, candidates = {"Rating", "Score"} <= set(kinds), None, None, None
    if {"Outcome", "Rating"} <= set(kinds):
        sums = scratch_table(spark, ops.move_totals(ops.timed_moves(moves)))
    if both:
        joined = scratch_table(spark, ops.relative_moves(
            info, moves, ("rating",), perspective).select("rating", "rel_time", "score"))
        candidates = scratch_table(spark, ops.list_candidates(moves, ENDS, perspective))
    paths = {kind: {} for kind in kinds}

    def path(kind, name):
        paths[kind][name] = f"{out}_{kind}_{name}"
        return paths[kind][name]

    def profile(table, kind, name):
        sinks.write_table(table, path(kind, name), mode)
        return spark.read.parquet(paths[kind][name])

    def pairs(table, kind, name):
        write = sinks.write_pairs if text else sinks.write_table
        write(table, path(kind, name), mode=mode)

    def lists(table, kind, name, values):
        if text:
            sinks.write_extremes_text(table, path(kind, name), values, mode)
        else:
            sinks.write_table(table, path(kind, name), mode)

    for kind in paths:
        if kind == "Outcome":
            totals = profile(ops.player_game_totals(info, moves, ("outcome",), sums), kind, "Totals")
            pairs(ops.outcome_values(totals), kind, "AverageMoveTimes")
            pairs(ops.outcome_values(totals, total_clock=True), kind, "SumMoveTimes")
        elif kind == "Rating":
            every = joined if both else ops.relative_moves(info, moves, ("rating",))
            pairs(every.select("rating", every["rel_time"].alias("value")), kind, "AllMoveTimes")
            pairs(ops.rating_values(ops.player_game_totals(info, moves, ("rating",), sums)),
                  kind, "AverageMoveTime")
            extremes = profile(
                ops.rating_extremes(info, moves, ENDS, candidates=candidates), kind, "Extremes")
            for end, name in LISTS:
                lists(extremes.select("game_id", "player", "rating", extremes[end].alias("times")),
                      kind, name, "times")
        else:
            every = joined if both else ops.relative_moves(info, moves, (), perspective)
            pairs(every.select("rel_time", "score"), kind, "AllMoveTimes")
            extremes = profile(
                ops.score_extremes(info, moves, ENDS, perspective, candidates=candidates),
                kind, "Extremes")
            for end, name in LISTS:
                lists(extremes.select("game_id", "player", extremes[end].alias("moves")), kind, name, "moves")
    return paths


def prepare_moves(moves, times, new_game, inputs=("move",)):
    """Moves with their clock times and scores, ready for ``sinks.write_moves``.

    ``times`` is what ``sources.clock_times`` extracts and ``new_game`` makes the
    scorer of a game, see ``operators.score_moves``.
    """
    timed = ops.attach_times(moves.drop("move_time"), times).drop("centipawn_score")
    keep = [c for c in timed.columns if c not in ("game_id", "move_no")]
    return ops.score_moves(timed, new_game, inputs, "centipawn_score", keep)


def main(argv=None):
    parser = argparse.ArgumentParser(description="Move-time analysis of chess games")
    parser.add_argument("kind", choices=KINDS)
    parser.add_argument("moves")
    parser.add_argument("info")
    parser.add_argument("out")
    parser.add_argument("--format", default="csv", help="input format, csv or parquet")
    parser.add_argument("--text", action="store_true", help="write text outputs")
    parser.add_argument("--perspective", default="player",
                        choices=("player", "score_parity", "white"))
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"move times: {args.kind}").getOrCreate()
    run_job(
        spark, args.kind,
        sources.read_moves(spark, args.moves, args.format),
        sources.read_game_info(spark, args.info, args.format),
        args.out, args.text, args.perspective,
    )


if __name__ == "__main__":
    main()
