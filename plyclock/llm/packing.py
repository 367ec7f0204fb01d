"""Packing documents into sequences by vector best-fit.

Every piece of a document takes tokens, one document slot and its attention cost (the
square of its length) from a sequence, and a sequence has a capacity for each.  Pieces
go longest first into the open sequence they fit in best, under every capacity:

``norm``  the weighted norm of what is left after the piece is smallest,
``dot``   the weighted dot product of the piece and what is left before is smallest.

The demand of a piece is a function of its length alone, and lengths are bounded by
the token capacity.  So the plan is made on the *number of pieces of each length*, of
which there are no more than tokens in a sequence, however many documents there are:
equal sequences are kept as one state with a count, and equal pieces are placed
together.  Pieces then find their place by their rank among those of their length.
Ranks come from counts per task and length, so a length that a third of all pieces
share is split over the tasks like any other.
"""

import bisect

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from plyclock.llm.common import stored, text_slices
from plyclock.llm.tokens import kept_encoder, tokenizer_path

TOKENS = 2048
WEIGHTS = (1.0, 1.0, 1.0)
END_ID = 0


def fits(length, left):
    """How many pieces of a length a sequence with these remainders can take."""
    tokens, slots, cost = left
    return min(tokens // length, slots, cost // (length * length))


def best_fit_plan(counts, capacity, rule="norm", weights=WEIGHTS):
    """Sequences for ``counts`` (pieces by length): ``[(copies, [(length, n), ...])]``.

    ``capacity`` is (tokens, documents, attention cost).  A piece that alone exceeds a
    capacity is an error.
    """
    if rule not in ("norm", "dot"):
        raise ValueError("the rule is norm or dot")
    whole = tuple(capacity)
    scale = [w / (c * c) for w, c in zip(weights, whole, strict=True)]

    def score(length, left):
        demand = (length, 1, length * length)
        if rule == "dot":
            return sum(s * d * x for s, d, x in zip(scale, demand, left, strict=True))
        return sum(s * (x - d) ** 2 for s, d, x in zip(scale, demand, left, strict=True))

    # Open sequences: remainders -> {contents: copies}.
    states = {}
    done = []

    def put(left, contents, copies):
        if left[0] == 0 or left[1] == 0 or left[2] == 0:
            done.append((copies, list(contents)))
        else:
            states.setdefault(left, []).append((copies, contents))

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        if todo and not fits(length, whole):
            raise ValueError(f"a piece of {length} tokens exceeds the capacity")
        order = sorted((s for s in states if fits(length, s)), key=lambda s: (score(length, s), s))
        while todo:
            left = order.pop(0) if order else whole
            held = states.pop(left, [(todo, ())]) if left != whole else [(todo, ())]
            # The rest of a sequence shrinks with each piece, so it stays the best
            # until it can take no more of this length.
            per = fits(length, left)
            for i, (copies, contents) in enumerate(held):
                full = min(copies, todo // per)
                if full:
                    put(less(left, length, per), (*contents, (length, per)), full)
                    todo -= full * per
                    copies -= full
                if copies and todo:
                    put(less(left, length, todo), (*contents, (length, todo)), 1)
                    todo, copies = 0, copies - 1
                if copies and left != whole:
                    states.setdefault(left, []).append((copies, contents))
                if not todo and left != whole:
                    states.setdefault(left, []).extend(held[i + 1:])
                    if not states[left]:
                        del states[left]
                    break
    for held in states.values():
        done += [(copies, list(contents)) for copies, contents in held]
    return done


def less(left, length, n):
    return left[0] - n * length, left[1] - n, left[2] - n * length * length


def places(plan):
    """For each length: first ranks, with (sequence, offset, pieces per copy) of each run."""
    runs, sequence = {}, 0
    for copies, contents in plan:
        offset = 0
        for length, n in contents:
            ranks, rows = runs.setdefault(length, ([], []))
            at = ranks[-1] + rows[-1][3] if ranks else 0
            ranks.append(at)
            rows.append((sequence, offset, n, n * copies))
            offset += n * length
        sequence += copies
    return runs


def pieces_of(docs, path=None, tokens=TOKENS, end_id=END_ID, keep_ids=False, keep=("doc_id",)):
    """Encoded documents, each closed by ``end_id`` and cut only above ``tokens``.

    ``*keep, piece, start, length, ids_crc32[, ids], task, nth``: ``nth`` numbers the pieces of
    a length within one task.  Null and empty texts give one piece, the end id.
    """
    path, keep = path or tokenizer_path(), list(keep)

    def run(batches):
        import zlib

        import numpy as np
        from pyspark import TaskContext

        encoder, task = kept_encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(tokens + 1, dtype=np.int64)
        for batch in batches:
            for at, texts in text_slices(batch.column("text")):
                flat, sizes = encoder.encode(texts)
                flat, sizes = np.insert(flat, np.cumsum(sizes), end_id), sizes + 1
                first = np.cumsum(sizes) - sizes
                n = -(-sizes // tokens)
                row = np.repeat(np.arange(len(sizes)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * tokens
                length = np.minimum(sizes[row] - start, tokens)
                a = first[row] + start
                # Numbers within a length, in order of appearance.
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(order) else []
                begins = np.flatnonzero(new)
                nth = np.empty(len(order), dtype=np.int64)
                nth[order] = np.arange(len(order)) - np.repeat(
                    begins, np.diff(np.concatenate([begins, [len(order)]])))
                nth += seen[length]
                seen += np.bincount(length, minlength=tokens + 1)
                data = memoryview(flat.tobytes())
                cut = [data[4 * x:4 * (x + y)] for x, y in zip(a, length, strict=True)]
                out = batch.slice(at, len(texts)).select(keep).take(pa.array(row))
                columns = {
                    "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start),
                    "length": pa.array(length),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in cut], pa.int64())}
                if keep_ids:
                    columns["ids"] = pa.array([bytes(x) for x in cut], pa.binary())
                columns |= {"task": pa.array(np.full(len(row), task, np.int32)), "nth": pa.array(nth)}
                yield pa.RecordBatch.from_arrays(
                    [*out.columns, *columns.values()], names=[*keep, *columns])

    head = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(
        run, f"{head}, piece int, start long, length long, ids_crc32 long"
             f"{', ids binary' if keep_ids else ''}, task int, nth long")


def pack_documents(docs, path=None, tokens=TOKENS, max_documents=None, max_cost=None,
                   end_id=END_ID, rule="norm", weights=WEIGHTS, keep_ids=False, keep=("doc_id",)):
    """One row per piece with ``sequence_id`` and ``offset``; nothing is left out.

    ``max_documents`` and ``max_cost`` default to values that never bind.  Repeated rows
    are packed as often as they occur; a null text is one piece of one token; an
    empty table gives no rows.
    """
    capacity = (tokens, max_documents or tokens, max_cost or tokens * tokens)
    pieces = stored(pieces_of(docs, path, tokens, end_id, keep_ids, keep))
    per_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    per_task = stored(per_task.withColumn(
        "before", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")))
    # At most one row per length.
    totals = per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()
    runs = places(best_fit_plan({r.length: r.n for r in totals}, capacity, rule, weights))
    ranked = pieces.join(
        per_task.select(F.col("length").alias("_length"), F.col("task").alias("_task"), "before"),
        (F.col("length") == F.col("_length")) & (F.col("task") == F.col("_task")),
    ).withColumn("rank", F.col("before") + F.col("nth"))
    columns = [c for c in pieces.columns if c not in ("task", "nth")]
    sent = pieces.sparkSession.sparkContext.broadcast(runs)

    def place(batches):
        import numpy as np

        for batch in batches:
            sequence, offset = [], []
            for length, rank in zip(batch.column("length").to_pylist(),
                                    batch.column("rank").to_pylist(), strict=True):
                ranks, rows = sent.value[length]
                i = bisect.bisect_right(ranks, rank) - 1
                first, at, n, _ = rows[i]
                copy, nth = divmod(rank - ranks[i], n)
                sequence.append(first + copy)
                offset.append(at + nth * length)
            yield pa.RecordBatch.from_arrays(
                [*batch.select(columns).columns, pa.array(np.array(sequence, np.int64)),
                 pa.array(np.array(offset, np.int64))], names=[*columns, "sequence_id", "offset"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*columns).schema)
    return ranked.select(*columns, "rank").mapInArrow(
        place, f"{head}, sequence_id long, offset long")
