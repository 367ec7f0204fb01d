"""Straight-line and sine fits.

Fits leave out pairs that are not finite, which a zero base time produces; one
such pair would turn every coefficient into NaN.
"""

from pyspark.sql import functions as F

from plyclock.functions import is_finite, two_sided_p
from plyclock.operators.moves import KEYS, timed_moves, with_score
from plyclock.operators.totals import counted_players
from plyclock.session import scratch_table

# Scores at or beyond this are mates, not evaluations.
MATE_LIMIT = 10000.0


def without_mates(scores):
    """Rows whose score is an evaluation rather than a mate."""
    return scores.filter(f"abs(score) < {MATE_LIMIT}")


def _both_finite(x, y):
    # One predicate on both columns: split in two, each half would be pushed into
    # the scan and the expression behind its column evaluated once more there.
    return is_finite(f"abs({x}) + abs({y})")


def fit_line(pairs, x, y, p_value=True):
    """Least-squares line ``y = slope * x + intercept``, one row.

    Columns ``slope, intercept, r, std_err, n`` and, unless switched off, the
    two-sided ``p`` of a zero slope.  One pass with map-side partial sums.
    """
    sums = pairs.filter(_both_finite(x, y)).agg(
        F.expr(f"regr_count({y}, {x}) AS n"),
        F.expr(f"regr_avgx({y}, {x}) AS _x"), F.expr(f"regr_avgy({y}, {x}) AS _y"),
        F.expr(f"regr_sxx({y}, {x}) AS _xx"), F.expr(f"regr_syy({y}, {x}) AS _yy"),
        F.expr(f"regr_sxy({y}, {x}) AS _xy"),
    )
    return _line(sums, p_value)


def fit_score_line(info, moves, perspective="player", p_value=True):
    """Line of relative move time over score, mates left out.

    The base time is constant within a player-game, so the moments a line needs are
    taken per player-game before the join and scaled by the base after it.  The moves
    themselves are never shuffled.  Moments are centred, within each player-game by its
    own means and between them by about the overall ones, so scores that hardly differ
    lose no digits.
    """
    scored = without_mates(with_score(timed_moves(moves), perspective))
    moments = scored.filter(is_finite("move_time")).groupBy(*KEYS).agg(
        F.expr("regr_count(move_time, score) AS _n"),
        F.expr("regr_avgx(move_time, score) AS _mx"), F.expr("regr_avgy(move_time, score) AS _my"),
        F.expr("regr_sxx(move_time, score) AS _xx"), F.expr("regr_syy(move_time, score) AS _yy"),
        F.expr("regr_sxy(move_time, score) AS _xy"),
    )
    players = counted_players(info).filter(f"base <> 0 AND {is_finite('base')}")
    games = players.join(moments, KEYS, "inner").selectExpr(
        "_copies * _n AS _w", "_mx", "_my / base AS _my", "_copies * _xx AS _xx",
        "_copies * _yy / (base * base) AS _yy", "_copies * _xy / base AS _xy")
    # Any point amid the means does; the exchanges below it are the same and run once.
    amid = games.agg(F.struct(F.avg("_mx").alias("x"), F.avg("_my").alias("y")).alias("at")).scalar()
    total = games.select("*", amid.getField("x").alias("_ax"), amid.getField("y").alias("_ay")).selectExpr(
        "*", "_mx - _ax AS _dx", "_my - _ay AS _dy").agg(
        F.expr("sum(_w) AS n"), F.expr("first(_ax) AS _ax"), F.expr("first(_ay) AS _ay"),
        F.expr("sum(_w * _dx) AS _sx"), F.expr("sum(_w * _dy) AS _sy"),
        F.expr("sum(_xx + _w * _dx * _dx) AS _sxx"), F.expr("sum(_yy + _w * _dy * _dy) AS _syy"),
        F.expr("sum(_xy + _w * _dx * _dy) AS _sxy"),
    )
    centred = total.filter("n > 0").selectExpr(
        "n", "_ax + _sx / n AS _x", "_ay + _sy / n AS _y",
        "_sxx - _sx * _sx / n AS _xx", "_syy - _sy * _sy / n AS _yy", "_sxy - _sx * _sy / n AS _xy",
    )
    return _line(centred, p_value)


def _line(sums, p_value):
    slope = "try_divide(_xy, _xx)"
    spread = "greatest(0D, _yy - try_divide(_xy * _xy, _xx))"
    line = sums.selectExpr(
        f"{slope} AS slope",
        f"_y - {slope} * _x AS intercept",
        "greatest(-1D, least(1D, try_divide(_xy, sqrt(_xx * _yy)))) AS r",
        f"CASE WHEN n = 2 THEN 0D WHEN n > 2 THEN sqrt(try_divide({spread}, (n - 2) * _xx)) END "
        "AS std_err",
        "n",
    )
    if not p_value:
        return line
    t = F.expr(
        "CASE WHEN abs(r) < 1 THEN r * sqrt((n - 2) / ((1 - r) * (1 + r))) "
        "WHEN r IS NOT NULL THEN double('Infinity') END"
    )
    return line.withColumn("p", two_sided_p(t, F.expr("n - 2")))


def line_at(fit, pairs, x):
    """Every ``x`` with its ``fitted`` value.

    Both coefficients come from one scalar subquery, so the fit runs once; no join.
    """
    line = fit.select(F.struct("slope", "intercept").alias("line")).scalar()
    fitted = line.getField("slope") * F.col(x) + line.getField("intercept")
    return pairs.select(x, fitted.alias("fitted"))


def line_grid(fit, values, x="x"):
    """``x, fitted`` at each given value, from the one-row fit."""
    grid = ", ".join(f"{float(v)!r}D" for v in values)
    return fit.selectExpr(f"explode(array({grid})) AS {x}", "slope", "intercept").selectExpr(
        x, f"slope * {x} + intercept AS fitted"
    )


def _sums_per_x(pairs, x, y):
    return (
        pairs.filter(_both_finite(x, y))
        .selectExpr(f"double({x}) AS _x", f"double({y}) AS _y")
        .groupBy("_x")
        .agg(F.expr("count(*) AS _n"), F.expr("sum(_y) AS _sy"), F.expr("sum(_y * _y) AS _syy"))
    )


def fit_sine_grid(pairs, x, y, frequencies):
    """Best ``a`` and residual sum of squares of ``a * sin(b * x)`` per ``b``.

    For a fixed ``b`` the best ``a`` has a closed form, so one aggregate covers
    the whole grid.  Pairs are first summed per distinct ``x``: scores repeat, so
    the sines are taken over the distinct scores, not over the moves.  A zero
    frequency is left out; it fits nothing.
    """
    per_x = _sums_per_x(pairs, x, y)
    grid = ", ".join(f"{float(f)!r}D" for f in frequencies if f != 0)
    waves = per_x.selectExpr("*", f"explode(array({grid})) AS b").selectExpr(
        "*", "sin(b * _x) AS _sin"
    )
    sums = waves.groupBy("b").agg(
        F.expr("sum(_sy * _sin) AS _ys"),
        F.expr("sum(_n * _sin * _sin) AS _ss"),
        F.expr("sum(_syy) AS _yy"),
    )
    return sums.selectExpr(
        "try_divide(_ys, _ss) AS a", "b",
        "_yy - coalesce(try_divide(_ys * _ys, _ss), 0D) AS rss",
    )


def best_sine(grid_fit):
    """The row with the least residual; ties go to the smallest ``|b|``."""
    return grid_fit.orderBy("rss", F.abs("b"), F.col("b").desc()).limit(1)


def refine_sine(pairs, x, y, a=1.0, b=1.0, steps=100, tolerance=1e-10):
    """Least-squares ``a`` and ``b`` of ``a * sin(b * x)`` near a start, one row.

    Columns ``a, b, rss, n``, the covariances ``var_a, cov_ab, var_b``, ``converged``
    and ``iterations``.  Damped Gauss-Newton: the pairs are summed per distinct ``x``
    once, into a scratch table, and every step is one aggregate of six sums over that
    table.  The minimum found is the one near the start; ``best_sine`` gives a good
    one.  ``converged`` is false where ``steps`` were too few or no step led down, and
    the values are then those of the best point seen, not of a minimum.

    Runs jobs when called.
    """
    spark = pairs.sparkSession
    per_x = scratch_table(spark, _sums_per_x(pairs, x, y))

    def sums(a, b):
        wave, slope = f"sin({b!r}D * _x)", f"({a!r}D * _x * cos({b!r}D * _x))"
        rest = f"(_sy - _n * {a!r}D * {wave})"
        return per_x.agg(
            F.expr(f"sum(_n * {wave} * {wave}) AS aa"),
            F.expr(f"sum(_n * {wave} * {slope}) AS ab"),
            F.expr(f"sum(_n * {slope} * {slope}) AS bb"),
            F.expr(f"sum({rest} * {wave}) AS ra"),
            F.expr(f"sum({rest} * {slope}) AS rb"),
            F.expr(f"sum(_syy - 2 * {a!r}D * {wave} * _sy "
                   f"+ _n * pow({a!r}D * {wave}, 2)) AS rss"),
            F.expr("sum(_n) AS n"),
        ).first()

    here, damping = sums(float(a), float(b)), 1e-3
    if not here.n:
        raise ValueError("no finite pairs to fit")
    converged, iterations = False, 0
    for iterations in range(1, steps + 1):
        aa, bb = here.aa * (1 + damping), here.bb * (1 + damping)
        det = aa * bb - here.ab * here.ab
        if not det > 0:
            break
        step_a = (bb * here.ra - here.ab * here.rb) / det
        step_b = (aa * here.rb - here.ab * here.ra) / det
        there = sums(a + step_a, b + step_b)
        if there.rss <= here.rss:
            a, b, damping, gain = a + step_a, b + step_b, damping / 10, here.rss - there.rss
            here = there
            if gain <= tolerance * here.rss:
                converged = True
                break
        elif damping > 1e12:
            break
        else:
            damping *= 10
    det = here.aa * here.bb - here.ab * here.ab
    spread = here.rss / (here.n - 2) / det if here.n > 2 and det > 0 else float("inf")
    return spark.createDataFrame(
        [(float(a), float(b), here.rss, here.n, here.bb * spread, -here.ab * spread,
          here.aa * spread, converged, iterations)],
        "a double, b double, rss double, n bigint, var_a double, cov_ab double, var_b double, "
        "converged boolean, iterations int",
    )


def beam_sine(pairs, x, y, b=1.0, reach=0.05, width=256, rounds=4):
    """Least-squares ``a`` and ``b`` of ``a * sin(b * x)`` with ``b`` within ``reach``, one row.

    Columns ``a, b, rss, n`` and the gradients ``grad_a, grad_b`` of half the residual sum.
    For each ``b`` the best ``a`` is known, so only ``b`` is searched: every round is one
    aggregate over ``width`` values at once and leaves the two steps around the best.  At the
    end the zero of the gradient between them is taken, as the residual itself is too flat
    to tell.  ``2 * reach / width`` must tell the waves of the residual apart, which are about
    ``pi / max|x|`` wide.  The pairs are summed per distinct ``x`` once, into a scratch table.

    Runs ``rounds + 1`` jobs over that table when called.
    """
    spark = pairs.sparkSession
    per_x = scratch_table(spark, _sums_per_x(pairs, x, y))

    def fits(values):
        grid = ", ".join(f"{v!r}D" for v in values)
        waves = per_x.selectExpr("*", f"explode(array({grid})) AS b").selectExpr(
            "*", "sin(b * _x) AS _sin", "_x * cos(b * _x) AS _slope")
        return sorted(waves.groupBy("b").agg(
            F.expr("sum(_sy * _sin) AS ys"), F.expr("sum(_n * _sin * _sin) AS ss"),
            F.expr("sum(_sy * _slope) AS yc"), F.expr("sum(_n * _sin * _slope) AS sc"),
            F.expr("sum(_syy) AS yy"), F.expr("sum(_n) AS n"),
        ).selectExpr(
            "b", "coalesce(try_divide(ys, ss), 0D) AS a", "n",
            "yy - coalesce(try_divide(ys * ys, ss), 0D) AS rss", "yc", "sc", "ys", "ss",
        ).selectExpr("*", "a * ss - ys AS grad_a", "a * (a * sc - yc) AS grad_b").collect(), key=lambda r: r.b)

    low, high = float(b) - reach, float(b) + reach
    for _ in range(rounds):
        step = (high - low) / width
        found = fits([low + i * step for i in range(width)] + [high])
        if not found:
            raise ValueError("no finite pairs to fit")
        at = min(range(len(found)), key=lambda i: (found[i].rss, i))
        before, after = found[max(0, at - 1)], found[min(len(found) - 1, at + 1)]
        low, high = before.b, after.b
    # The zero of the gradient between the two, which is a straight line there.
    best = found[at]
    if before.grad_b < 0 < after.grad_b:
        share = before.grad_b / (before.grad_b - after.grad_b)
        best = fits([before.b + share * (after.b - before.b)])[0]
    return spark.createDataFrame(
        [(best.a, best.b, best.rss, best.n, best.grad_a, best.grad_b)],
        "a double, b double, rss double, n bigint, grad_a double, grad_b double")
