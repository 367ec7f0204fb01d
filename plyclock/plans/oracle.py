"""The same queries as plain SQL over the driver's tables."""

from plyclock.schemas import OUTCOME_LABELS

CHESS = """
info AS (
  SELECT c_custkey AS game_id,
         'w' || CAST(c_custkey AS VARCHAR) AS white,
         'b' || CAST(c_custkey AS VARCHAR) AS black,
         CASE c_custkey % 3 WHEN 0 THEN '1-0' WHEN 1 THEN '0-1' ELSE '1/2-1/2' END AS result,
         CAST(1000 + (c_custkey * 37) % 1500 AS INTEGER) AS white_elo,
         CAST(1000 + (c_custkey * 53) % 1500 AS INTEGER) AS black_elo,
         CASE WHEN c_custkey % 50 = 7 THEN '0+12'
              WHEN c_custkey % 5 = 0 THEN '60+0'
              WHEN c_custkey % 5 = 1 THEN '180+2'
              WHEN c_custkey % 5 = 2 THEN '300+5'
              WHEN c_custkey % 5 = 3 THEN '600+10'
              ELSE '900+0' END AS time_control
  FROM customer),
numbered AS (
  SELECT o_custkey AS game_id, l_partkey, l_suppkey, l_quantity, o_orderdate,
         CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey,
              l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS move_no
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
moves AS (
  SELECT game_id,
         CASE WHEN move_no % 2 = 1 THEN 'w' ELSE 'b' END || CAST(game_id AS VARCHAR) AS player,
         move_no,
         substring('abcdefgh', CAST(l_partkey % 8 + 1 AS INTEGER), 1)
           || CAST(l_suppkey % 8 + 1 AS VARCHAR) AS move,
         l_quantity - 1 AS move_time,
         CASE WHEN l_partkey % 97 = 0 THEN '#+3'
              WHEN l_partkey % 97 = 1 THEN '#-2'
              WHEN (l_partkey * 31 + l_suppkey) % 801 - 400 > 0
                THEN '+' || CAST((l_partkey * 31 + l_suppkey) % 801 - 400 AS VARCHAR)
              ELSE CAST((l_partkey * 31 + l_suppkey) % 801 - 400 AS VARCHAR)
         END AS centipawn_score,
         CAST(month(o_orderdate) AS INTEGER) AS month
  FROM numbered),
clocks AS (
  SELECT *, CAST(split_part(time_control, '+', 1) AS DOUBLE) AS base,
         CAST(split_part(time_control, '+', 2) AS DOUBLE) AS increment
  FROM info),
players AS (
  SELECT game_id, white AS player, 'w' AS side, 'w' || result AS outcome,
         white_elo AS rating, base, increment FROM clocks
  UNION ALL
  SELECT game_id, black, 'b', 'b' || result, black_elo, base, increment FROM clocks),
timed AS (SELECT * FROM moves WHERE move_no NOT IN (1, 2)),
scored AS (
  SELECT *, CASE WHEN centipawn_score LIKE '%#%'
                 THEN CASE WHEN substring(centipawn_score, 2, 1) = '-' THEN -100000.0 ELSE 100000.0 END
                 ELSE CAST(centipawn_score AS DOUBLE) END AS white_score
  FROM moves),
sided AS (
  SELECT *, (CASE WHEN move_no % 2 = 0 THEN -white_score ELSE white_score END) + 0.0 AS player_score,
         (CASE WHEN white_score % 2 = 0 THEN -white_score ELSE white_score END) + 0.0 AS parity_score
  FROM scored),
rel AS (
  SELECT p.*, m.move_no, m.move_time, m.move_time / p.base AS rel_time,
         m.player_score, m.parity_score
  FROM players p JOIN sided m ON p.game_id = m.game_id AND p.player = m.player
  WHERE m.move_no NOT IN (1, 2)),
totals AS (
  SELECT game_id, player, outcome, rating, base, increment,
         count(*) AS n_moves, sum(move_time) AS total_time,
         CASE WHEN base = 0 THEN avg(rel_time) ELSE sum(move_time) / base / count(*) END AS avg_value,
         sum(move_time) / (base + increment * count(*)) AS share_value
  FROM rel GROUP BY game_id, player, outcome, rating, base, increment),
lists AS (
  SELECT game_id, player, rating, list(rel_time ORDER BY rel_time, move_time, move_no) AS t,
         list(player_score ORDER BY rel_time, move_time, move_no) AS s
  FROM rel GROUP BY game_id, player, rating HAVING count(*) > 10)
"""


def with_chess(body):
    return f"WITH {CHESS.strip()}{body if body.lstrip().startswith(',') else ' ' + body}"


def shown(expression, name, digits=9):
    return (
        f"CASE WHEN isfinite({expression}) THEN round({expression}, {digits}) END AS {name}, "
        f"CASE WHEN isinf({expression}) THEN 1 ELSE 0 END AS is_inf, "
        f"CASE WHEN isnan({expression}) THEN 1 ELSE 0 END AS is_nan"
    )


def spread(items, prefix="t", flags=True):
    columns = [
        f"CASE WHEN isfinite({x}) THEN round({x}, 9) END AS {prefix}{i}"
        for i, x in enumerate(items, 1)
    ]
    if flags:
        for test, name in (("isinf", "n_inf"), ("isnan", "n_nan")):
            terms = " + ".join(f"CASE WHEN {test}({x}) THEN 1 ELSE 0 END" for x in items)
            columns.append(f"{terms} AS {name}")
    return ", ".join(columns)


FAST = [f"t[{i}]" for i in range(1, 6)]
SLOW = [f"t[-{i}]" for i in range(1, 6)]
LAST_FIVE = [f"t[-{i}]" for i in range(5, 0, -1)]


def scores_of(indexes):
    return ", ".join(f"s[{i}] AS s{n}" for n, i in enumerate(indexes, 1))


LABELS = ", ".join(
    f"('{code}', '{label}')" for code, label in OUTCOME_LABELS
)


def stats(value):
    return with_chess(f""",
    labels(outcome, label) AS (VALUES {LABELS}),
    viable AS (SELECT outcome, {value} AS v FROM totals WHERE {value} <> CAST('inf' AS DOUBLE))
    SELECT l.outcome, l.label, count(v.outcome) AS count,
           round(avg(v) FILTER (NOT isnan(v)), 9) AS mean,
           round(stddev_samp(v) FILTER (NOT isnan(v)), 9) AS std
    FROM labels l LEFT JOIN viable v ON l.outcome = v.outcome GROUP BY l.outcome, l.label""")


def histogram(value, high):
    return with_chess(f""",
    labels(outcome, label) AS (VALUES {LABELS}),
    bins AS (SELECT CAST(b AS INTEGER) AS bin FROM range(50) r(b)),
    edges AS (SELECT bin, CAST(bin AS DOUBLE) * w AS lo, CAST(bin + 1 AS DOUBLE) * w AS hi
              FROM bins, (SELECT CAST({high} AS DOUBLE) / 50 AS w)),
    filled AS (
      SELECT t.outcome, e.bin FROM totals t JOIN edges e
        ON {value} >= e.lo
       AND ({value} < e.hi OR (e.bin = 49 AND {value} <= CAST({high} AS DOUBLE)))
       AND {value} <= CAST({high} AS DOUBLE))
    SELECT l.outcome, b.bin, count(f.bin) AS count
    FROM labels l CROSS JOIN bins b
    LEFT JOIN filled f ON f.outcome = l.outcome AND f.bin = b.bin GROUP BY l.outcome, b.bin""")


LINE = """
  SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, corr(y, x) AS r,
         sqrt((regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x))
              / (count(*) - 2) / regr_sxx(y, x)) AS std_err,
         count(*) AS n
  FROM xy"""
RATING_XY = "xy AS (SELECT rating AS x, avg_value AS y FROM totals WHERE isfinite(avg_value))"
SCORE_XY = (
    "xy AS (SELECT player_score AS x, rel_time AS y FROM rel "
    "WHERE abs(player_score) < 10000 AND isfinite(rel_time))"
)
SHOWN_LINE = (
    "SELECT round(slope, 12) AS slope, round(intercept, 9) AS intercept, round(r, 9) AS r, "
    "round(std_err, 12) AS std_err, n FROM line"
)


def line(xy, select=SHOWN_LINE):
    return with_chess(f", {xy}, line AS ({LINE}) {select}")


def grid(xy, values, name):
    return line(xy, f"SELECT CAST(g AS DOUBLE) AS {name}, round(slope * g + intercept, 9) AS fitted "
                    f"FROM line, range({values}) r(g)")


SINE = f""", {SCORE_XY},
    freq AS (SELECT CAST(i AS DOUBLE) / CAST(1000 AS DOUBLE) AS b FROM range(1, 41) r(i)),
    waves AS (
      SELECT b, sum(y * sin(b * x)) AS ys, sum(sin(b * x) * sin(b * x)) AS ss, sum(y * y) AS yy
      FROM xy CROSS JOIN freq GROUP BY b),
    fits AS (SELECT b, round(ys / ss, 9) AS a, round(yy - ys * ys / ss, 6) AS rss,
                    yy - ys * ys / ss AS exact FROM waves)"""


def p_value(name, xy):
    """The tail of Student's t by the continued fraction of the incomplete beta function."""
    return with_chess(f""", {xy}, line AS ({LINE}),
    beta AS (
      SELECT n, (n - 2) / 2.0 AS a0, (n - 2) / (n - 2 + t * t) AS x0
      FROM (SELECT n, r * sqrt((n - 2) / ((1 - r) * (1 + r))) AS t FROM line)),
    side AS (
      SELECT n, x0 >= (a0 + 1) / (a0 + 2.5) AS turned,
             CASE WHEN x0 < (a0 + 1) / (a0 + 2.5) THEN a0 ELSE 0.5 END AS a,
             CASE WHEN x0 < (a0 + 1) / (a0 + 2.5) THEN 0.5 ELSE a0 END AS b,
             CASE WHEN x0 < (a0 + 1) / (a0 + 2.5) THEN x0 ELSE 1 - x0 END AS x FROM beta),
    lentz AS (
      SELECT 0 AS m, n, turned, a, b, x, CAST(1 AS DOUBLE) AS c,
             1 / (1 - (a + b) * x / (a + 1)) AS d, 1 / (1 - (a + b) * x / (a + 1)) AS h, CAST(0 AS DOUBLE) AS last
      FROM side
      UNION ALL
      SELECT m, n, turned, a, b, x, 1 + odd / c1, 1 / (1 + odd * d1),
             h * d1 * c1 * (1 + odd / c1) / (1 + odd * d1), h
      FROM (SELECT m + 1 AS m, n, turned, a, b, x, h, 1 + even / c AS c1, 1 / (1 + even * d) AS d1, odd
            FROM (SELECT *, (m + 1) * (b - m - 1) * x / ((a + 2 * m + 1) * (a + 2 * m + 2)) AS even,
                         -(a + m + 1) * (a + b + m + 1) * x / ((a + 2 * m + 2) * (a + 2 * m + 3)) AS odd
                  FROM lentz WHERE abs(h - last) > 1e-15 * abs(h) AND m < 20000))),
    tail AS (
      SELECT n, turned, exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(x) + b * ln(1 - x)) * h / a AS part
      FROM lentz QUALIFY row_number() OVER (ORDER BY m DESC) = 1)
    SELECT '{name}' AS fit, n, round(CASE WHEN turned THEN 1 - part ELSE part END, 8) AS p FROM tail""") \
        .replace("WITH ", "WITH RECURSIVE ", 1)


def refined_sine(rounds=6, width=60):
    """The best wave near b = 1: ever finer grids, then the zero of the slope at the best of the last."""
    parts = [f", {SCORE_XY}, per_x AS (SELECT x, count(*) AS n, sum(y) AS sy, sum(y * y) AS syy FROM xy GROUP BY x), "
             f"b0 AS (SELECT CAST(0.95 AS DOUBLE) AS lo, CAST(1.05 AS DOUBLE) AS hi)"]
    sums = ("sum(sy * sin(b * x)) AS ys, sum(n * sin(b * x) * sin(b * x)) AS ss, sum(sy * x * cos(b * x)) AS yc, "
            "sum(n * x * sin(b * x) * cos(b * x)) AS sc, sum(syy) AS yy, CAST(sum(n) AS BIGINT) AS n")
    for i in range(rounds):
        parts.append(f"""g{i} AS (SELECT lo + (hi - lo) * k / {width} AS b FROM b{i}, range({width + 1}) r(k)),
    f{i} AS (SELECT b, yy - ys * ys / ss AS rss, ys / ss * (ys / ss * sc - yc) AS slope
             FROM (SELECT b, {sums} FROM g{i}, per_x GROUP BY b)),
    n{i} AS (SELECT *, lag(b) OVER (ORDER BY b) AS lo, lead(b) OVER (ORDER BY b) AS hi,
                    lag(slope) OVER (ORDER BY b) AS s0, lead(slope) OVER (ORDER BY b) AS s1 FROM f{i}),
    b{i + 1} AS (SELECT coalesce(lo, b) AS lo, coalesce(hi, b) AS hi, s0, s1 FROM n{i} ORDER BY rss, b LIMIT 1)""")
    last = f"(SELECT lo + (hi - lo) * s0 / (s0 - s1) AS b FROM b{rounds})"
    return with_chess(", ".join(parts) + f""", done AS (SELECT b, {sums} FROM {last}, per_x GROUP BY b)
    SELECT round(ys / ss, 9) AS a, round(b, 8) AS b, round(yy - ys * ys / ss, 6) AS rss, n, 1 AS flat FROM done""")


def rank_means(items):
    means = ", ".join(
        f"avg({x}) FILTER (NOT isnan({x})) AS m{i}" for i, x in enumerate(items, 1)
    )
    return f", means AS (SELECT rating, {means} FROM lists GROUP BY rating)"


MEANS = [f"m{i}" for i in range(1, 6)]
BAR = (
    "(" + " + ".join(f"coalesce({m}, 0.0)" for m in MEANS) + ") / ("
    + " + ".join(f"CASE WHEN {m} IS NULL THEN 0 ELSE 1 END" for m in MEANS) + ")"
)


def bars(items):
    has_any = " OR ".join(f"{m} IS NOT NULL" for m in MEANS)
    return with_chess(
        f"{rank_means(items)}, bars AS (SELECT rating, CASE WHEN {has_any} THEN {BAR} END AS v "
        f"FROM means) SELECT rating, {shown('v', 'mean_time')} FROM bars"
    )


def points(items):
    parts = " UNION ALL ".join(
        f"SELECT rating, {i} AS rank, {x} AS v FROM lists" for i, x in enumerate(items, 1)
    )
    return with_chess(
        f", points AS ({parts}) SELECT rating, rank, {shown('v', 'time')} FROM points"
    )


TEXT_COLUMNS = (
    "'(' || CAST(game_id AS VARCHAR) || ' ' || player || ' ' || CAST(rating AS VARCHAR) AS key, "
    "5 AS n_fields, "
)

def job_outputs():
    finite = "list_sum(list_filter({}, lambda x: isfinite(x)))"
    outputs = [
        ("Outcome", "AverageMoveTimes", "totals", "avg_value"), ("Outcome", "SumMoveTimes", "totals", "share_value"),
        ("Rating", "AllMoveTimes", "rel", "rel_time"), ("Rating", "AverageMoveTime", "totals", "avg_value"),
        ("Rating", "FastestMoveTimes", "lists", finite.format("t[1:5]")),
        ("Rating", "SlowestMoveTimes", "lists", finite.format("t[-5:]")),
        ("Score", "AllMoveTimes", "rel", "rel_time"),
        ("Score", "FastestMoveTimes", "lists", finite.format("t[1:5]")),
        ("Score", "SlowestMoveTimes", "lists", finite.format("t[-5:]")),
    ]
    return with_chess(" UNION ALL ".join(
        f"SELECT '{kind}' AS kind, '{name}' AS output, count(*) AS n, "
        f"round(sum(v) FILTER (isfinite(v)), 6) AS total FROM (SELECT {value} AS v FROM {table})"
        for kind, name, table, value in outputs))


ORACLE = {
    "quarantined_moves": with_chess("""
    SELECT game_id, move_no, concat_ws(',', CASE WHEN move_no % 9 = 4 THEN 'move_time' END,
             CASE WHEN move_no % 13 = 6 THEN 'centipawn_score' END) AS wrong,
           CASE WHEN move_no % 9 = 4 THEN 'x' ELSE '' END || CAST(CAST(move_time AS BIGINT) AS VARCHAR) AS raw_time,
           (SELECT count(*) FROM moves WHERE NOT (move_no % 9 = 4 OR move_no % 13 = 6)) AS n_good,
           (SELECT count(*) FROM moves WHERE move_no % 9 = 4 OR move_no % 13 = 6) AS n_bad
    FROM moves WHERE move_no % 9 = 4 OR move_no % 13 = 6"""),
    "job_outputs": job_outputs(),
    "key_value_files": with_chess(
        f"SELECT rating AS ranking, {shown('avg_value', 'avg_move_time')} FROM totals"),
    "result_folders": with_chess(
        ", appended AS (SELECT outcome, avg_value AS v FROM totals UNION ALL SELECT outcome, share_value FROM totals) "
        f"SELECT outcome, {shown('v', 'value')} FROM appended"),
    "raw_exports": with_chess(
        "SELECT CAST(game_id AS VARCHAR) AS game_id, player, rating, move_no, player_score AS score, "
        f"{shown('rel_time', 'rel_time')} FROM rel"),
    "scan_moves": with_chess(
        "SELECT game_id, player, move_no, move_time, centipawn_score FROM moves"),
    "scan_game_info": with_chess("SELECT * FROM info"),
    "typed_moves": with_chess(
        "SELECT CAST(game_id AS VARCHAR) AS game_id, player, move_no, move_time, centipawn_score "
        "FROM moves"),
    "timed_moves": with_chess("SELECT game_id, player, move_no, move_time FROM timed"),
    "monthly_union": with_chess(
        "SELECT month, game_id, player, move_no, move_time FROM moves"),
    "time_control": with_chess("SELECT game_id, base, increment FROM clocks"),
    "outcome_codes": with_chess(
        "SELECT game_id, 'w' || result AS white_outcome, 'b' || result AS black_outcome FROM info"),
    "player_games": with_chess("SELECT * FROM players"),
    "parse_score": with_chess("SELECT game_id, move_no, white_score AS score FROM scored"),
    "score_perspective_player": with_chess(
        "SELECT game_id, move_no, player_score AS score FROM sided"),
    "score_perspective_parity": with_chess(
        "SELECT game_id, move_no, parity_score AS score FROM sided"),
    "relative_times": with_chess(
        f"SELECT game_id, player, move_no, {shown('rel_time', 'rel_time')} FROM rel"),
    "join_moves_players": with_chess(
        "SELECT p.*, m.move_no, m.move_time FROM players p "
        "JOIN timed m ON p.game_id = m.game_id AND p.player = m.player"),
    "pgn_move_times": with_chess("SELECT game_id, move_no, move_time FROM moves"),
    "pgn_moves": with_chess(
        "SELECT game_id, move_no, substring(player, 1, 1) AS side, move FROM moves"),
    "attach_times": with_chess("SELECT game_id, move_no, player, move_time FROM moves"),
    "reconcile_times": with_chess(
        ", counts AS (SELECT game_id, count(*) AS n_moves, "
        "count(*) FILTER (centipawn_score NOT LIKE '%#%') AS n_times FROM moves GROUP BY game_id) "
        "SELECT game_id, n_moves, n_times, CAST(n_moves = n_times AS INTEGER) AS matches FROM counts"),
    "score_moves_fold": with_chess(
        "SELECT game_id, move_no, sum(move_time) OVER "
        "(PARTITION BY game_id ORDER BY move_no) AS score FROM moves"),
    "outcome_avg_move_time": with_chess(
        ", a AS (SELECT game_id, player, outcome, avg(rel_time) AS v FROM rel GROUP BY ALL) "
        f"SELECT outcome, {shown('v', 'value')} FROM a"),
    "outcome_sum_share": with_chess(f"SELECT outcome, {shown('share_value', 'value')} FROM totals"),
    "outcome_labels": with_chess(
        f", labels(outcome, label) AS (VALUES {LABELS}) "
        "SELECT outcome, label, count(*) AS count FROM totals LEFT JOIN labels USING (outcome) "
        "GROUP BY outcome, label"),
    "viable_outcomes": with_chess(
        "SELECT 'average' AS kind, count(*) AS viable FROM totals "
        "WHERE avg_value <> CAST('inf' AS DOUBLE) "
        "UNION ALL SELECT 'total', count(*) FROM totals WHERE share_value <> CAST('inf' AS DOUBLE)"),
    "outcome_stats_avg": stats("avg_value"),
    "outcome_stats_total": stats("share_value"),
    "outcome_hist_avg": histogram("avg_value", "0.1"),
    "outcome_hist_total": histogram("share_value", "1.0"),
    "rating_all_move_times": with_chess(f"SELECT rating, {shown('rel_time', 'value')} FROM rel"),
    "rating_avg_move_time": with_chess(
        ", a AS (SELECT game_id, player, rating, avg(rel_time) AS v FROM rel GROUP BY ALL) "
        f"SELECT rating, {shown('v', 'value')} FROM a"),
    "eligible_player_games": with_chess(
        "SELECT game_id, player, rating, n_moves FROM totals WHERE n_moves > 10"),
    "rating_fastest5": with_chess(f"SELECT game_id, player, rating, {spread(FAST)} FROM lists"),
    "rating_slowest5": with_chess(f"SELECT game_id, player, rating, {spread(SLOW)} FROM lists"),
    "score_all_move_times": with_chess(
        f"SELECT player_score AS score, {shown('rel_time', 'rel_time')} FROM rel"),
    "score_all_move_times_parity": with_chess(
        f"SELECT parity_score AS score, {shown('rel_time', 'rel_time')} FROM rel"),
    "score_nonmate": with_chess(
        f"SELECT player_score AS score, {shown('rel_time', 'rel_time')} FROM rel "
        "WHERE abs(player_score) < 10000"),
    "score_fastest5": with_chess(
        f"SELECT game_id, player, {spread(FAST)}, {scores_of(range(1, 6))} FROM lists"),
    "score_slowest5": with_chess(
        f"SELECT game_id, player, {spread(LAST_FIVE)}, {scores_of(range(-5, 0))} FROM lists"),
    "top5_text_form": with_chess(
        f"SELECT {TEXT_COLUMNS}{spread(FAST, flags=False)} FROM lists"),
    "parse_top5_text": with_chess(f"SELECT game_id, player, rating, {spread(FAST)} FROM lists"),
    "top5_points_fast": points(FAST),
    "top5_points_slow": points(SLOW),
    "top5_rank_means_fast": with_chess(
        f"{rank_means(FAST)} SELECT rating, {spread(MEANS, 'rank')} FROM means"),
    "top5_rank_means_slow": with_chess(
        f"{rank_means(SLOW)} SELECT rating, {spread(MEANS, 'rank')} FROM means"),
    "top5_rating_bar_fast": bars(FAST),
    "top5_rating_bar_slow": bars(SLOW),
    "fit_rating_time": line(RATING_XY),
    "fit_score_time": line(SCORE_XY),
    "fit_rating_predictions": line(
        RATING_XY,
        "SELECT rating, round(slope * rating + intercept, 9) AS fitted FROM totals, line"),
    "fit_rating_grid": grid(RATING_XY, "500, 3001, 500", "rating"),
    "fit_score_grid": grid(SCORE_XY, "-4000, 4001, 500", "score"),
    "fit_score_sine_grid": with_chess(f"{SINE} SELECT b, a, rss FROM fits"),
    "fit_score_sine_best": with_chess(
        f"{SINE} SELECT b, a, rss FROM fits ORDER BY exact, abs(b), b DESC LIMIT 1"),
    "fit_p_values": f"({p_value('rating', RATING_XY)}) UNION ALL ({p_value('score', SCORE_XY)})",
    "fit_score_sine_refined": refined_sine(),
}
