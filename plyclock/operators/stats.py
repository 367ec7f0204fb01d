"""Summary statistics and histograms per outcome group."""

from pyspark.sql import functions as F

from plyclock.functions import nan_to_null
from plyclock.functions.numbers import INFINITY
from plyclock.schemas import OUTCOME_LABELS


def viable(values):
    """Rows whose value is not positive infinity.  NaN stays."""
    return values.filter(f"value != {INFINITY}")


def outcome_labels(values):
    """Add the readable ``label`` of each outcome code; other codes get NULL."""
    table = F.create_map(*[F.lit(x) for pair in OUTCOME_LABELS for x in pair])
    return values.withColumn("label", F.try_element_at(table, F.col("outcome")))


def _label_rows(spark):
    rows = ", ".join(f"('{code}', '{label}')" for code, label in OUTCOME_LABELS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(outcome, label)")


def outcome_stats(values):
    """``outcome, label, count, mean, std`` for the six groups, empty ones included.

    Infinite values are left out.  NaN values are counted but skipped by the
    mean and the sample standard deviation.
    """
    x = nan_to_null("value")
    groups = viable(values).groupBy("outcome").agg(
        F.expr("count(*) AS _count"), F.expr(f"avg({x}) AS mean"),
        F.expr(f"stddev_samp({x}) AS std"),
    )
    return _label_rows(values.sparkSession).join(groups, "outcome", "left").selectExpr(
        "outcome", "label", "coalesce(_count, 0) AS count", "mean", "std"
    )


def outcome_histogram(values, low=0.0, high=0.1, bins=50):
    """``outcome, bin, count`` with every bin of the six groups present.

    Bins have equal width; a value on an inner edge belongs to the bin above it,
    the last bin includes ``high``, and values outside the range are ignored.
    The first guess is corrected against the edges, since the division may round
    across one.
    """
    low, high = float(low), float(high)
    width, low_text, high_text = f"{(high - low) / bins!r}D", f"{low!r}D", f"{high!r}D"
    guess = (
        f"least(floor((value - {low_text}) * {bins} / ({high_text} - {low_text})), {bins - 1})"
    )
    inside = values.filter(f"value BETWEEN {low_text} AND {high_text}").selectExpr(
        "outcome", "value", f"{guess} AS _guess"
    )
    bin_no = f"""
        CASE WHEN value < _guess * {width} + {low_text} THEN _guess - 1
             WHEN value >= (_guess + 1) * {width} + {low_text} AND _guess < {bins - 1}
             THEN _guess + 1 ELSE _guess END"""
    counts = inside.groupBy("outcome", F.expr(f"int({bin_no}) AS bin")).agg(
        F.expr("count(*) AS _count")
    )
    every_bin = _label_rows(values.sparkSession).selectExpr(
        "outcome", f"explode(sequence(0, {bins - 1})) AS bin"
    )
    return every_bin.join(counts, ["outcome", "bin"], "left").selectExpr(
        "outcome", "bin", "coalesce(_count, 0) AS count"
    )
