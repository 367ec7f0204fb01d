"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so its
size follows the document and any two sketches stay comparable, however unequal the
documents.  A document with shingles but none below the threshold keeps its smallest.
Sketches merge by union, and estimate likeness (Jaccard) and containment.

Everything here is a Spark column expression.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

WORDS = 5
#: One hash in so many is kept.
SCALE = 4
LIMIT = -(1 << 63) + (1 << 64) // SCALE


def shingle_hashes(text, words=WORDS):
    """Hashes of the runs of five words; one for the whole of a shorter text.

    Words are what white space separates.  A null, empty or blank text has none.
    """
    parts = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def rolled(parts):
        # Past the end there is null, which a hash passes over.
        return F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(parts) - words, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(parts, i + k) for k in range(words)]))

    # The outer transform names the words, so that they are split once.
    named = F.transform(F.array(parts), lambda p: F.when(F.size(p) > 0, rolled(p)))
    return F.coalesce(named[0], F.array().cast("array<bigint>"))


def kept(hashes):
    """The sketch of an array of hashes: sorted, distinct."""
    def of(h):
        low = F.filter(h, lambda x: x < LIMIT)
        return F.when(F.size(low) > 0, F.sort_array(F.array_distinct(low))).when(
            F.size(h) > 0, F.array(F.array_min(h))).otherwise(F.array().cast("array<bigint>"))

    return F.transform(F.array(hashes), of)[0]


def sketch(text):
    return kept(shingle_hashes(F.coalesce(text, F.lit(""))))


def merged(a, b):
    """The sketch of two documents together."""
    return kept(F.array_union(a, b))


def likeness(a, b):
    """Jaccard estimate, 0 to 1; two sketches without a hash are alike."""
    shared = F.size(F.array_intersect(a, b))
    whole = F.size(a) + F.size(b) - shared
    return F.when(whole == 0, 1.0).otherwise(shared / F.greatest(whole, F.lit(1)))


def containment(a, b):
    """How much of ``a`` lies in ``b``, 0 to 1; nothing lies in anything."""
    return F.when(F.size(a) == 0, 1.0).otherwise(
        F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1)))


def written(sketch):
    """A sketch as text: hexadecimal hashes with commas between."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.hex(h))), ",")


def with_next(docs, made, parts=None):
    """Add ``next_<column>`` of the following document by falling doc_id; the last one's is the first.

    ``docs`` has doc_id and text, and ``made`` names further columns made from the text,
    as expressions; these are made once per row.  Ties go by text.  Rows are ordered within ranges of
    doc_ids, and the few rows that begin a range are carried over to the range before,
    so no task sees all rows.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # As many numbers as there are ranges.
    bounds = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10_000)
                      .alias("b")).first()["b"] if parts > 1 else None
    bounds = sorted(set(bounds or []))
    place = F.lit(0) if not bounds else F.size(F.filter(
        F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col("doc_id")))
    ranged = docs.withColumn("_range", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(place))
    first = {r["_range"]: r["top"] for r in ranged.groupBy("_range").agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(first, reverse=True)
    follow = [(r, first[order[(i + 1) % len(order)]]) for i, r in enumerate(order)]
    heads = docs.join(
        F.broadcast(spark.createDataFrame(follow, "_of int, _top long")),
        F.col("doc_id").eqNullSafe(F.col("_top")),
    ).groupBy("_of").agg(F.min("text").alias("text")).withColumns(made)
    columns = ["text", *made]
    window = Window.partitionBy("_range").orderBy(F.col("doc_id").desc(), "text")
    ahead = ranged.withColumns(made).withColumns(
        {f"_lead_{c}": F.lead(c).over(window) for c in columns}
        | {"_more": F.lead(F.lit(True)).over(window)})
    joined = ahead.join(
        heads.select("_of", *[F.col(c).alias(f"_head_{c}") for c in columns]),
        F.col("_range") == F.col("_of"), "left")
    return joined.select("doc_id", *columns, *[
        F.when(F.col("_more"), F.col(f"_lead_{c}")).otherwise(F.col(f"_head_{c}")).alias(f"next_{c}")
        for c in columns])


def with_edited(docs):
    """Fingerprints of texts and of their edited forms.

    ``doc_id, n_chars, edited, sketch, next_sketch, edited_sketch``.  The last third of
    a text, rounded down, is replaced by as much of the beginning of the next document as
    there is.  Null counts as empty.  Repeated rows follow each other; a lone document
    follows itself; an empty table gives no rows; other columns are not looked at.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce("text", F.lit("")).alias("text"))
    own = with_next(plain, {"sketch": sketch(F.col("text"))})
    n = F.char_length("text")
    m = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - m),
                      F.substring(F.col("next_text"), F.lit(1), m))
    return own.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch",
                      "next_sketch").withColumn("edited_sketch", sketch(F.col("edited")))
