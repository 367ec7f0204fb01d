"""What the third round mended: memory of the language stage, shuffles of phrases."""

import sys
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from plyclock.llm import langid, phrases, tokens


def test_language_needs_little_memory_and_forgets_encoders():
    """What a worker holds while it names languages stays small, whatever ran in it before."""
    rng = np.random.default_rng(3)
    letters = rng.integers(ord("a"), ord("z") + 1, (60_000, 9)).astype("u1")
    words = [w.tobytes().decode() for w in letters]
    batch = pa.RecordBatch.from_pydict({"text": [" ".join(words[i:i + 100]) for i in range(0, 60_000, 100)]})
    size = len(langid.Pieces().pieces)
    even = np.full(size, 1 / size)
    docs = SimpleNamespace(
        columns=["text"], schema=T.StructType([T.StructField("text", T.StringType())]),
        mapInArrow=lambda run, schema: run,
        sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda v: SimpleNamespace(value=v))))
    run = langid.identify(docs, {"a": even, "b": even, "c": even, "d": even})
    tokens.kept_encoder(tokens.tokenizer_path())
    tracemalloc.start()
    try:
        found = [x for out in run([batch]) for x in out.column("lang_pred").to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == ["a"] * 600
    assert tokens.tokenizer_path() not in vars(sys.modules[tokens.KEPT])
    assert peak < 75e6, peak


def test_few_rare_words_and_pairs_pass_the_filter(spark):
    """What is sent to meet the frequent words and pairs is little more than those themselves."""
    wanted = [(i * 31, i * 17 + 5) for i in range(300)]
    frame = spark.createDataFrame(wanted, "x long, y long")
    bitmap = phrases.frequent_filter(frame, lambda bits: phrases.place_of_pair(frame.x, frame.y, bits)).value
    x, y = (np.array(v, np.int64) for v in zip(*wanted, strict=True))
    assert phrases.is_set(bitmap, phrases.place_of_pair(x, y, 64 * len(bitmap))).all()
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 100_000, (2, 20_000))
    assert phrases.is_set(bitmap, phrases.place_of_pair(x, y, 64 * len(bitmap))).mean() < 0.1


def test_phrases_do_not_depend_on_filter_and_rounds(spark, monkeypatch):
    """A filter that lets much through, small slices and many rounds give the same phrases."""
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{min(int(n), 400)}" for n in rng.zipf(1.3, 60)) for _ in range(300)]
    docs = spark.createDataFrame([(t, "en" if i % 3 else None) for i, t in enumerate(texts)],
                                 "text string, lang string").repartition(5)

    def found():
        return sorted(map(tuple, phrases.mine_phrases(docs, least=5).collect()))

    usual = found()
    assert len(usual) > 50
    for name, value in (("MOST_BITS", 4096), ("FILTER_BITS", 1), ("TOGETHER", 2), ("ADDED_PAIRS", 3),
                        ("SLICE_BYTES", 2000)):
        monkeypatch.setattr(phrases, name, value)
    assert found() == usual
