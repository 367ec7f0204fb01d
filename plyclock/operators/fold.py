"""Scoring every move of a game in order with a caller's scorer.

A scorer keeps state from move to move, so the moves of one game must be seen in
order by one task.  Games are hashed over the tasks and sorted by ply inside
each; the rows then stream through in Arrow batches.  Only the open game's state
is held, never a whole game, so a very long game costs time but not memory.
"""

from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_text(scores, size):
    """One run's scores as an array of text, None where a score is missing."""
    values = pd.Series(scores)
    if len(values) != size:
        raise ValueError(f"{len(values)} scores for {size} moves")
    text = values.astype(str).to_numpy(object)
    text[values.isna().to_numpy()] = None
    return text


def score_moves(moves, new_game, inputs=("move",), score="centipawn_score", keep=()):
    """One score per move, as text: ``game_id, move_no, *keep, score``.

    ``keep`` names columns to carry along, which saves joining the scores back.

    ``new_game()`` returns a scorer for one game, a callable.  It is given
    successive runs of that game's moves as a frame of the ``inputs`` columns, in
    playing order, and returns one score per row: the evaluation after the move,
    in White's view; None and NaN give NULL.  A move with a NULL ``game_id`` belongs to no
    game and stops the job.  A scorer from a module of yours needs that module on the
    executors, by ``addPyFile`` for example.
    """
    kept = list(dict.fromkeys(["game_id", "move_no", *keep]))
    columns = list(dict.fromkeys([*kept, *inputs]))
    schema = T.StructType(
        [*moves.select(*kept).schema, T.StructField(score, T.StringType())]
    )

    def run(batches):
        game, scorer = None, None
        for batch in batches:
            if batch.empty:
                continue
            ids, rows, scores = batch["game_id"].to_numpy(), batch[list(inputs)], []
            cuts = np.flatnonzero(ids[1:] != ids[:-1]) + 1
            for start, end in pairwise([0, *cuts, len(ids)]):
                if scorer is None or ids[start] != game:
                    game, scorer = ids[start], new_game()
                scores.append(as_text(scorer(rows.iloc[start:end]), end - start))
            yield batch[kept].assign(**{score: np.concatenate(scores)})

    ordered = (
        moves.select(*columns)
        .withColumn("game_id", F.expr("coalesce(game_id, raise_error('a move without a game'))"))
        .repartition("game_id")
        .sortWithinPartitions("game_id", "move_no")
    )
    return ordered.mapInPandas(run, schema)
