"""Summaries of the five-move lists by rating, and their text form."""

from pyspark.sql import functions as F

from plyclock.functions import nan_to_null


def rank_points(extremes):
    """``rating, rank, time``: one row for each entry of each list, rank from 1."""
    points = extremes.selectExpr("rating", "posexplode(times) AS (_pos, time)")
    return points.selectExpr("rating", "_pos + 1 AS rank", "time")


def rank_means(extremes, k=5):
    """Mean of each rank per rating: ``rating, rank1 .. rankK``.

    NaN is skipped, and so are lists without a rating.
    """
    means = [
        F.expr(f"avg({nan_to_null(f'get(times, {i})')}) AS rank{i + 1}") for i in range(k)
    ]
    return extremes.filter("rating IS NOT NULL").groupBy("rating").agg(*means)


def rating_bars(means, k=5):
    """``rating, mean_time``: mean over the rank means that are present."""
    ranks = [f"rank{i + 1}" for i in range(k)]
    total = " + ".join(f"coalesce({r}, 0D)" for r in ranks)
    present = " + ".join(f"int({r} IS NOT NULL)" for r in ranks)
    return means.selectExpr("rating", f"try_divide({total}, {present}) AS mean_time")


def extremes_text(extremes, values="times"):
    """One text line per list: ``(key parts,[a, b, c, d, e])``.

    The key parts are the columns before the list.  Lists of structs print each
    entry as ``(a,b)``.
    """
    keys = [c for c in extremes.columns if c != values]
    element = extremes.schema[values].dataType.elementType

    def shown(entry):
        if element.typeName() != "struct":
            return entry.cast("string")
        fields = [entry[f].cast("string") for f in element.fieldNames()]
        return F.concat(F.lit("("), F.concat_ws(",", *fields), F.lit(")"))

    listed = F.concat_ws(", ", F.transform(values, shown))
    return extremes.select(
        F.concat(
            F.lit("("), F.concat_ws(" ", *[F.col(c).cast("string") for c in keys]),
            F.lit(",["), listed, F.lit("])"),
        ).alias("value")
    )
