"""One query per operator, over the whole of the driver's tables.

Numbers are rounded so that both engines print them alike, and values that are
not finite are shown as NULL with flags.
"""

from pyspark.sql import functions as F

from plyclock import operators as ops
from plyclock import sinks, sources
from plyclock.functions import (
    clock_base,
    clock_increment,
    opponent_aware_score,
    outcome_code,
    parse_score,
)
from plyclock.operators.totals import CLOCK_SHARE
from plyclock.plans.jobs import KINDS, run_jobs
from plyclock.plans.projection import chess_game_info, chess_moves, chess_movetext
from plyclock.schemas import GAME_INFO, MOVES, OUTCOME_VALUES
from plyclock.session import scratch_path, scratch_table

# Grids at which fits are reported.
RATING_GRID = range(500, 3001, 500)
SCORE_GRID = range(-4000, 4001, 500)
SINE_GRID = [i / 1000 for i in range(1, 41)]

DIGITS = 9
FINE_DIGITS = 12


def rounded(table, **digits):
    """Round the named columns."""
    return table.withColumns({name: F.round(name, n) for name, n in digits.items()})


def shown(table, column, digits=DIGITS):
    """Replace a column by its rounded finite value and two flags."""
    others = [c for c in table.columns if c != column]
    return table.selectExpr(
        *others,
        f"CASE WHEN abs({column}) < double('Infinity') THEN round({column}, {digits}) END "
        f"AS {column}",
        f"int(abs({column}) <=> double('Infinity')) AS is_inf",
        f"int(coalesce(isnan({column}), false)) AS is_nan",
    )


def list_columns(table, source, prefix="t", field=None, k=5, keep=()):
    """Spread a list over ``prefix1 .. prefixK``, with counts of the rest."""
    items = f"{source}.{field}" if field else source
    spread = [
        f"CASE WHEN abs(get({items}, {i})) < double('Infinity') "
        f"THEN round(get({items}, {i}), {DIGITS}) END AS {prefix}{i + 1}"
        for i in range(k)
    ]
    return table.selectExpr(
        *keep,
        *spread,
        f"size(filter({items}, x -> abs(x) = double('Infinity'))) AS n_inf",
        f"size(filter({items}, x -> isnan(x))) AS n_nan",
    )


class Games:
    """The chess tables and the intermediate results queries start from."""

    def __init__(self, spark, sf_dir):
        self.spark = spark
        self.info = chess_game_info(spark, sf_dir)
        self.moves = chess_moves(spark, sf_dir)

    def totals(self, *attributes):
        return ops.player_game_totals(self.info, self.moves, attributes)

    def outcome_values(self, total_clock=False):
        return ops.outcome_values(self.totals("outcome"), total_clock)

    def rating_values(self):
        return ops.rating_values(self.totals("rating"))

    def score_pairs(self, perspective="player"):
        return ops.relative_moves(self.info, self.moves, (), perspective).select(
            "game_id", "move_no", "rel_time", "score"
        )

    def rating_fit(self, p_value=False):
        return ops.fit_line(self.rating_values(), "rating", "value", p_value)

    def score_fit(self, p_value=False):
        return ops.fit_score_line(self.info, self.moves, p_value=p_value)

    def sine_grid(self):
        return ops.fit_sine_grid(
            ops.without_mates(self.score_pairs()), "score", "rel_time", SINE_GRID
        )


# Sources and projections

def scan_moves(g):
    return g.moves.select("game_id", "player", "move_no", "move_time", "centipawn_score")


def scan_game_info(g):
    return g.info


def typed_moves(g):
    as_text = g.moves.select(
        *[F.col(c).cast("string").alias(c)
          for c in ("game_id", "player", "move_no", "move_time", "centipawn_score")]
    )
    return sources.typed_moves(as_text)


def timed_moves(g):
    return ops.timed_moves(g.moves).select("game_id", "player", "move_no", "move_time")


def monthly_union(g):
    """Moves written month by month, and the months read as one table."""
    path = scratch_path(g.spark)
    sinks.write_moves(g.moves, path, partition_by=["month"])
    months = [r.month for r in g.moves.select("month").distinct().collect()]
    paths = {month: f"{path}/month={month}" for month in sorted(months)}
    return sources.read_months(g.spark, paths, sources.read_moves, fmt="parquet").select(
        "month", "game_id", "player", "move_no", "move_time")


def time_control(g):
    return g.info.selectExpr(
        "game_id", f"{clock_base('time_control')} AS base",
        f"{clock_increment('time_control')} AS increment",
    )


def outcome_codes(g):
    return g.info.selectExpr(
        "game_id", f"{outcome_code('w', 'result')} AS white_outcome",
        f"{outcome_code('b', 'result')} AS black_outcome",
    )


def player_games(g):
    return ops.player_games(g.info)


def scores(g):
    return g.moves.selectExpr("game_id", "move_no", f"{parse_score('centipawn_score')} AS score")


def score_perspective(g, perspective):
    score = opponent_aware_score(parse_score("centipawn_score"), "move_no", perspective)
    return g.moves.selectExpr("game_id", "move_no", f"{score} AS score")


def relative_times(g):
    rel = ops.relative_moves(g.info, g.moves, ())
    return shown(rel.select("game_id", "player", "move_no", "rel_time"), "rel_time")


def join_moves_players(g):
    timed = ops.timed_moves(g.moves).select("game_id", "player", "move_no", "move_time")
    return ops.join_moves_players(timed, ops.player_games(g.info))


# Archives

def pgn_move_times(g):
    return sources.clock_times(chess_movetext(g.moves))


def pgn_moves(g):
    return sources.pgn_moves(chess_movetext(g.moves))


def attach_times(g):
    moves = scratch_table(g.spark, g.moves.select("game_id", "move_no", "player", "move", "move_time"))
    untimed = moves.select("game_id", "move_no", "player")
    return ops.attach_times(untimed, sources.clock_times(chess_movetext(moves)))


def reconcile_times(g):
    moves = scratch_table(g.spark, g.moves.select("game_id", "move_no", "move", "move_time", "centipawn_score"))
    times = sources.clock_times(chess_movetext(moves, without_mate_times=True))
    counts = ops.reconcile_times(moves, times)
    return counts.withColumn("matches", F.col("matches").cast("int"))


class RunningTime:
    """Scorer for the fold query: time used so far in the game."""

    def __init__(self):
        self.total = 0.0

    def __call__(self, rows):
        sums = rows["move_time"].cumsum() + self.total
        self.total = float(sums.iloc[-1])
        return sums


def score_moves_fold(g):
    folded = ops.score_moves(g.moves, RunningTime, inputs=("move_time",), score="score")
    return folded.withColumn("score", F.col("score").cast("double"))


# Outcome

def outcome_labels(g):
    labelled = ops.outcome_labels(g.outcome_values())
    return labelled.groupBy("outcome", "label").agg(F.count("*").alias("count"))


def viable_outcomes(g):
    """Both kinds of value from one pass over the totals."""
    values = g.totals("outcome").selectExpr(
        f"stack(2, 'average', mean_rel_time, 'total', {CLOCK_SHARE}) AS (kind, value)")
    counts = ops.viable(values).agg(*[
        F.count_if(F.col("kind") == kind).alias(kind) for kind in ("average", "total")])
    return counts.selectExpr("stack(2, 'average', average, 'total', total) AS (kind, viable)")


def outcome_stats(g, total_clock):
    stats = ops.outcome_stats(g.outcome_values(total_clock))
    return rounded(stats, mean=DIGITS, std=DIGITS)


def outcome_hist(g, total_clock):
    return ops.outcome_histogram(
        g.outcome_values(total_clock), 0.0, 1.0 if total_clock else 0.1, 50
    )


# Rating and score

def rating_all_move_times(g):
    rel = ops.relative_moves(g.info, g.moves, ("rating",))
    return shown(rel.select("rating", F.col("rel_time").alias("value")), "value")


def score_all_move_times(g, perspective):
    return shown(g.score_pairs(perspective).select("rel_time", "score"), "rel_time")


def score_nonmate(g):
    return shown(ops.without_mates(g.score_pairs()).select("rel_time", "score"), "rel_time")


def eligible_player_games(g):
    return ops.eligible_player_games(g.totals("rating")).select(
        "game_id", "player", "rating", "n_moves"
    )


def rating_lists(g, end):
    return ops.rating_extremes(g.info, g.moves, end)


def rating_list_columns(g, end):
    return list_columns(rating_lists(g, end), "times", keep=("game_id", "player", "rating"))


def score_list_columns(g, end):
    lists = ops.score_extremes(g.info, g.moves, end)
    scores_shown = [f"get(moves, {i}).score AS s{i + 1}" for i in range(5)]
    return list_columns(lists, "moves", field="rel_time",
                        keep=("game_id", "player", *scores_shown))


def parsed_text(g):
    text = ops.extremes_text(rating_lists(g, "fastest"))
    parsed = sources.parse_extremes_text(text).withColumn(
        "game_id", F.col("game_id").cast("bigint")
    )
    return list_columns(parsed, "times", keep=("game_id", "player", "rating"))


def text_form(g):
    """The key part of each line, and its list part field by field."""
    text = ops.extremes_text(rating_lists(g, "fastest"))
    fields = text.selectExpr(
        "substring_index(value, ',', 1) AS key",
        r"split(regexp_extract(value, r'\[(.*)\]\)$', 1), ', ') AS _fields",
    ).selectExpr("key", "size(_fields) AS n_fields", "transform(_fields, x -> double(x)) AS times")
    return list_columns(fields, "times", keep=("key", "n_fields")).drop("n_inf", "n_nan")


def top5_points(g, end):
    return shown(ops.rank_points(rating_lists(g, end)), "time")


def top5_rank_means(g, end):
    means = ops.rank_means(rating_lists(g, end))
    ranks = F.array(*[f"rank{i}" for i in range(1, 6)])
    wide = means.select("rating", ranks.alias("times"))
    return list_columns(wide, "times", prefix="rank", keep=("rating",))


def top5_rating_bar(g, end):
    return shown(ops.rating_bars(ops.rank_means(rating_lists(g, end))), "mean_time")


# Fits

def shown_fit(fit):
    return rounded(fit, slope=FINE_DIGITS, intercept=DIGITS, r=DIGITS, std_err=FINE_DIGITS)


def fit_predictions(g):
    return rounded(ops.line_at(g.rating_fit(), g.rating_values(), "rating"), fitted=DIGITS)


def fit_grid(fit, values, x):
    return rounded(ops.line_grid(fit, values, x), fitted=DIGITS)


def sine_grid(grid):
    return rounded(grid.select("b", "a", "rss"), a=DIGITS, rss=6)


def sine_refined(g):
    """The best wave near the start of the published fit, b = 1, and whether it is a minimum."""
    pairs = ops.without_mates(g.score_pairs())
    fit = ops.beam_sine(pairs, "score", "rel_time", 1.0, 0.05)
    flat = "int(abs(grad_a) <= 1e-9 * n AND abs(grad_b) <= 1e-6 * n) AS flat"
    return rounded(fit.selectExpr("a", "b", "rss", "n", flat), a=DIGITS, b=8, rss=6)


def fit_p_values(g):
    fits = {"rating": g.rating_fit(True), "score": g.score_fit(True)}
    return sources.append_tables(
        [fit.select(F.lit(name).alias("fit"), "n", F.round("p", 8).alias("p")) for name, fit in fits.items()]
    )


# Jobs and their files

def job_outputs(g):
    """All three jobs, and of each output the number of rows and the sum of its finite values."""
    out = scratch_path(g.spark)
    values = {"AllMoveTimes": "value", "AverageMoveTimes": "value", "SumMoveTimes": "value",
              "AverageMoveTime": "value", "FastestMoveTimes": "times", "SlowestMoveTimes": "times"}
    shown_rows = []
    for kind, paths in run_jobs(g.spark, KINDS, g.moves, g.info, f"{out}/january").items():
        for name in sorted(set(paths) & set(values)):
            table = g.spark.read.parquet(paths[name])
            column = {("Score", "value"): "rel_time", ("Score", "times"): "moves.rel_time"}.get(
                (kind, values[name]), values[name])
            if values[name] == "times":
                column = f"aggregate(filter({column}, x -> abs(x) < double('Infinity')), 0D, (s, x) -> s + x)"
            shown_rows.append(table.selectExpr(f"{column} AS v").selectExpr(
                f"'{kind}' AS kind", f"'{name}' AS output", "count(*) AS n",
                "round(sum(CASE WHEN abs(v) < double('Infinity') THEN v END), 6) AS total"))
    return sources.append_tables(shown_rows)


def key_value_files(g):
    """Average times by rating as ``key,value`` text, read with names of the reader's choice."""
    path = scratch_path(g.spark)
    sinks.write_pairs(g.rating_values(), path)
    return shown(sources.read_pairs(g.spark, path, "ranking int, avg_move_time double"), "avg_move_time")


def result_folders(g):
    """Two folders of part files, appended."""
    paths = [scratch_path(g.spark) for _ in range(2)]
    for path, total_clock in zip(paths, (False, True), strict=True):
        sinks.write_pairs(g.outcome_values(total_clock), path)
    return shown(sources.read_pairs(g.spark, paths, OUTCOME_VALUES), "value")


def raw_exports(g):
    """Moves and games as text with a header, found again by the names in it, and joined."""
    folder = scratch_path(g.spark)
    sinks.write_moves(g.moves, f"{folder}/january_moves.csv", fmt="csv")
    g.info.write.option("header", True).csv(f"{folder}/january_game_info.csv")
    moves = sources.read_moves(
        g.spark, f"{folder}/january_moves.csv", columns={n: n for n in MOVES})
    info = sources.read_game_info(
        g.spark, f"{folder}/january_game_info.csv", columns={n: n for n in GAME_INFO})
    rel = ops.relative_moves(info, moves, ("rating",), "player")
    return shown(rel.select("game_id", "player", "rating", "move_no", "score", "rel_time"), "rel_time")


def quarantined_moves(g):
    """Moves as text, some of them damaged: the bad ones, with what is wrong and how many there are."""
    text = g.moves.selectExpr(
        "game_id", "player", "string(move_no) AS move_no",
        "CASE WHEN move_no % 9 = 4 THEN concat('x', int(move_time)) ELSE string(int(move_time)) END AS move_time",
        "CASE WHEN move_no % 13 = 6 THEN 'none' ELSE centipawn_score END AS centipawn_score")
    tagged = sources.typed_moves(text, on_bad="tag")
    _, bad, counts = sinks.quarantine(tagged, scratch_path(g.spark))
    return bad.select(
        "game_id", "move_no", F.array_join("bad", ",").alias("wrong"), F.col("raw.move_time").alias("raw_time"),
        F.lit(counts["good"]).alias("n_good"), F.lit(counts["bad"]).alias("n_bad"))


QUERIES = {
    "quarantined_moves": quarantined_moves,
    "job_outputs": job_outputs,
    "key_value_files": key_value_files,
    "result_folders": result_folders,
    "raw_exports": raw_exports,
    "scan_moves": scan_moves,
    "scan_game_info": scan_game_info,
    "typed_moves": typed_moves,
    "timed_moves": timed_moves,
    "monthly_union": monthly_union,
    "time_control": time_control,
    "outcome_codes": outcome_codes,
    "player_games": player_games,
    "parse_score": scores,
    "score_perspective_player": lambda g: score_perspective(g, "player"),
    "score_perspective_parity": lambda g: score_perspective(g, "score_parity"),
    "relative_times": relative_times,
    "join_moves_players": join_moves_players,
    "pgn_move_times": pgn_move_times,
    "pgn_moves": pgn_moves,
    "attach_times": attach_times,
    "reconcile_times": reconcile_times,
    "score_moves_fold": score_moves_fold,
    "outcome_avg_move_time": lambda g: shown(g.outcome_values(), "value"),
    "outcome_sum_share": lambda g: shown(g.outcome_values(True), "value"),
    "outcome_labels": outcome_labels,
    "viable_outcomes": viable_outcomes,
    "outcome_stats_avg": lambda g: outcome_stats(g, False),
    "outcome_stats_total": lambda g: outcome_stats(g, True),
    "outcome_hist_avg": lambda g: outcome_hist(g, False),
    "outcome_hist_total": lambda g: outcome_hist(g, True),
    "rating_all_move_times": rating_all_move_times,
    "rating_avg_move_time": lambda g: shown(g.rating_values(), "value"),
    "eligible_player_games": eligible_player_games,
    "rating_fastest5": lambda g: rating_list_columns(g, "fastest"),
    "rating_slowest5": lambda g: rating_list_columns(g, "slowest"),
    "score_all_move_times": lambda g: score_all_move_times(g, "player"),
    "score_all_move_times_parity": lambda g: score_all_move_times(g, "score_parity"),
    "score_nonmate": score_nonmate,
    "score_fastest5": lambda g: score_list_columns(g, "fastest"),
    "score_slowest5": lambda g: score_list_columns(g, "slowest"),
    "top5_text_form": text_form,
    "parse_top5_text": parsed_text,
    "top5_points_fast": lambda g: top5_points(g, "fastest"),
    "top5_points_slow": lambda g: top5_points(g, "slowest"),
    "top5_rank_means_fast": lambda g: top5_rank_means(g, "fastest"),
    "top5_rank_means_slow": lambda g: top5_rank_means(g, "slowest"),
    "top5_rating_bar_fast": lambda g: top5_rating_bar(g, "fastest"),
    "top5_rating_bar_slow": lambda g: top5_rating_bar(g, "slowest"),
    "fit_rating_time": lambda g: shown_fit(g.rating_fit()),
    "fit_score_time": lambda g: shown_fit(g.score_fit()),
    "fit_rating_predictions": fit_predictions,
    "fit_rating_grid": lambda g: fit_grid(g.rating_fit(), RATING_GRID, "rating"),
    "fit_score_grid": lambda g: fit_grid(g.score_fit(), SCORE_GRID, "score"),
    "fit_score_sine_grid": lambda g: sine_grid(g.sine_grid()),
    "fit_score_sine_best": lambda g: sine_grid(ops.best_sine(g.sine_grid())),
    "fit_score_sine_refined": sine_refined,
    "fit_p_values": fit_p_values,
}


def bind(query):
    """A query as the driver calls it: (spark, folder) to DataFrame."""
    return lambda spark, sf_dir: query(Games(spark, sf_dir))
