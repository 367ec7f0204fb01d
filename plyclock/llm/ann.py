"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: the signs after rotations that are learned to lose little
by it (principal axes, then alternating between codes and the best rotation).  The
codes are split into substrings of eight bits, each with an index from its value to
the vectors that have it.  For a Hamming radius R the substrings get error limits t
with the sum of (t + 1) equal to R + 1: a code within R of the query's is within t in
at least one substring, so probing every value within the limits retrieves all codes
within the radius.  What lies within the radius is ranked by the inner product
of the original vectors.

For inner products, vectors are lengthened to equal norm by one component that is 0
in queries, so the largest inner product is the smallest angle.

The radius is learned too, as the one that finds ``RECALL`` of the true neighbours in
a sample; in all rows neighbours are nearer than in a sample of them.

Queries against rows is work in proportion to both.  It is dealt to cells, a shard of
the rows and a block of the queries, each of bounded size.
"""

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Window
from pyspark.sql import functions as F

from plyclock.llm.common import stored

BITS, SUBSTRING = 128, 8
SAMPLE = 6000
RECALL = 0.97
SHARD, QUERIES = 8192, 4096


def usable(vectors, column="embedding"):
    """``vec_id, v``: rows whose vector is neither null nor zero and has finite components only."""
    return vectors.select(F.col("vec_id").cast("long"), F.col(column).cast("array<double>").alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(F.coalesce(x, F.lit(0.0))))
        & F.exists("v", lambda x: x != 0))


@dataclass(frozen=True)
class Codes:
    """Learned codes: ``planes`` are directions in the lengthened space."""

    planes: Any
    norm: float
    radius: int

    def signs(self, vectors, query=False):
        """Codes as rows of +1 and -1."""
        import numpy as np

        return np.where(lengthened(vectors, self.norm, query) @ self.planes >= 0, 1, -1).astype(np.float32)


def lengthened(vectors, norm, query=False):
    import numpy as np

    if query:
        size = np.linalg.norm(vectors, axis=1, keepdims=True)
        return np.hstack([vectors / size, np.zeros((len(vectors), 1))])
    inside = vectors / norm
    rest = np.sqrt(np.maximum(0.0, 1 - (inside**2).sum(axis=1, keepdims=True)))
    return np.hstack([inside, rest])


def learned_planes(sample, bits=BITS, rounds=30, seed=3):
    """Directions from as many learned rotations as the bits need."""
    import numpy as np

    rng = np.random.default_rng(seed)
    values, axes = np.linalg.eigh(sample.T @ sample)
    axes = axes[:, np.argsort(-values)][:, :min(bits, (values > 1e-9 * values.max()).sum())]
    low = sample @ axes
    planes = []
    while sum(p.shape[1] for p in planes) < bits:
        turn = np.linalg.qr(rng.normal(size=(low.shape[1],) * 2))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(low @ turn >= 0, 1.0, -1.0).T @ low)
            turn = (u @ vt).T
        planes.append(axes @ turn)
    return np.hstack(planes)[:, :bits]


def fit_codes(rows, sample=SAMPLE, bits=BITS, k=20, recall=RECALL):
    """Learn codes from at most ``sample`` rows of the commonest width, chosen by a hash of the id.

    None for an empty table.
    """
    import numpy as np

    commonest = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if not commonest:
        return None
    rows = rows.filter(F.size("v") == commonest.width)
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    data = np.array([r.v for r in chosen])
    norm = rows.select(F.max(F.expr("sqrt(aggregate(v, 0D, (s, x) -> s + x * x))"))).first()[0]
    planes = learned_planes(lengthened(data, norm), bits)
    codes = Codes(planes, norm, bits)
    asked = data[: min(len(data), 400)]
    near = np.argsort(-(asked @ data.T), axis=1)[:, 1:k + 1]
    distance = (bits - codes.signs(asked, True) @ codes.signs(data).T) / 2
    found = np.take_along_axis(distance, near, axis=1)
    radius = int(np.ceil(np.quantile(found, recall))) if found.size else bits
    return Codes(planes, norm, min(bits, radius))


def error_limits(radius, bits=BITS, width=SUBSTRING):
    """Errors allowed in each substring; -1 where it need not be probed."""
    parts = bits // width
    limits = [(radius + 1) // parts - 1 + (i < (radius + 1) % parts) for i in range(parts)]
    return [min(width, t) for t in limits]


def substrings(signs, width=SUBSTRING):
    import numpy as np

    return np.packbits(signs > 0, axis=1) if width == 8 else None


class SubstringIndex:
    """For every substring and value, the rows that a probe within the limit reaches."""

    def __init__(self, parts, limits):
        import numpy as np

        errors = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8))
        self.reached = []
        for s, limit in enumerate(limits):
            if limit < 0:
                continue
            order = np.argsort(parts[:, s], kind="stable").astype(np.int32)
            edges = np.searchsorted(parts[order, s], np.arange(257))
            rows = [order[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
            self.reached.append((s, [
                np.concatenate([rows[v] for v in np.flatnonzero(errors[u] <= limit)]) for u in range(256)]))

    def mark(self, query, marks):
        for s, reached in self.reached:
            marks[reached[query[s]]] = True


def search(queries, rows, codes, k=20):
    """``query_id, vec_id, score``: up to ``k`` rows within the radius for each query and cell, best first."""
    spark = rows.sparkSession
    shards = max(1, -(-rows.count() // SHARD))
    blocks = max(1, -(-queries.count() // QUERIES))
    data = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")) \
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")) \
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    sent = spark.sparkContext.broadcast((codes.planes, codes.norm, codes.radius))
    limits = error_limits(codes.radius)

    def cell(left, right):
        import numpy as np
        import pandas as pd

        codes = Codes(*sent.value)
        width = codes.planes.shape[0] - 1
        left, right = (t[t.v.map(len) == width] for t in (left, right))
        out = []
        if len(left) and len(right):
            q, x = np.stack(left.v.to_numpy()), np.stack(right.v.to_numpy())
            names, ids = left.vec_id.to_numpy(), right.vec_id.to_numpy()
            of_q, of_x = codes.signs(q, True), codes.signs(x)
            index, parts = SubstringIndex(substrings(of_x), limits), substrings(of_q)
            for i in range(len(q)):
                marks = np.zeros(len(x), bool)
                index.mark(parts[i], marks)
                near = np.flatnonzero(marks)
                distance = (BITS - of_x[near] @ of_q[i]) / 2
                near = near[(distance <= codes.radius) & (ids[near] != names[i])]
                score = x[near] @ q[i]
                best = np.lexsort((ids[near], -score))[:k]
                out.append((np.full(len(best), names[i]), ids[near[best]], score[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], []]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    return asked.groupBy("shard", "block").cogroup(data.groupBy("shard", "block")).applyInPandas(
        cell, "query_id long, vec_id long, score double")


def nearest(vectors, is_query, k=20, column="embedding"):
    """``query_id, rank, vec_id, score`` of the ``k`` nearest rows of each query.

    Rows that are null, zero, not finite or of another width than the commonest take no part, as
    queries or as neighbours, nor do rows without a vec_id.  Rows that share a vec_id count
    once: of different vectors the least, by its components in order, stands for the id.
    Ties go to the smaller vec_id; a query is not its own neighbour.  A query that finds fewer than ``k`` within
    the radius is asked again without one, so it gets all there are.  An empty table
    gives no rows; other columns are not looked at.
    """
    rows = stored(usable(vectors, column).groupBy("vec_id").agg(F.min("v").alias("v")))
    queries = rows.filter(is_query)
    codes = fit_codes(rows, k=k)
    spark = vectors.sparkSession
    if codes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = stored(ranked(search(queries, rows, codes, k), k))
    enough = best.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k)
    short = stored(queries.join(enough, F.col("vec_id") == F.col("query_id"), "left_anti"))
    if not short.limit(1).count():
        return best
    again = ranked(search(short, rows, Codes(codes.planes, codes.norm, BITS), k), k)
    return best.join(enough, "query_id", "left_semi").select(best.columns).unionByName(again)


def ranked(found, k):
    window = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k) \
        .select("query_id", F.col("rank").cast("int"), "vec_id", "score")
