"""Numeric expressions.

Arguments are column names or SQL expressions; results are SQL text, which
composes with ``selectExpr``, ``expr`` and the lambdas of array functions.
"""

INFINITY = "double('Infinity')"


def ieee_divide(numerator, denominator):
    """Floating division where x/0 is a signed Infinity and 0/0 is NaN.

    Plain ``/`` raises under ANSI mode and gives NULL otherwise.  NULL in
    either operand stays NULL.
    """
    n, d = f"double({numerator})", f"double({denominator})"
    # x * Infinity has the wanted value for every x, zero and NaN included.
    return f"coalesce(try_divide({n}, {d}), {n} * CASE WHEN {d} = 0 THEN {INFINITY} END)"


def nan_to_null(value):
    """NaN becomes NULL, so that aggregates skip it."""
    return f"nanvl({value}, NULL)"


def is_finite(value):
    """Neither NULL, NaN nor infinite."""
    return f"abs({value}) < {INFINITY}"


def strict_cast(value, to, name):
    """Cast that fails the job on text that does not parse, and on NULL.

    Independent of the session's ANSI setting.
    """
    shown = f"coalesce(CAST({value} AS STRING), 'NULL')"
    fail = f"raise_error(concat('bad value for {name}: ', {shown}))"
    return f"coalesce(try_cast({value} AS {to}), CAST({fail} AS {to}))"
