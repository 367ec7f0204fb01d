"""Grouping of spelling variants: words of a corpus that differ by one edit.

Words are runs of Latin letters.  Two words are *near* if one inserted, deleted or replaced
code point makes one of the other.  A word's *form* is its near word of largest count, if
that is ``ratio`` times its own; following forms to the last gives its *root*.

Near words are found by dynamic programming over a sorted list.  For one word, the rows of
its edit matrix against every word of the list are kept in a band of three cells, as edits
beyond one do not matter.  The next word of the list shares its first letters with the one
before and so the rows of those, up to their longest common prefix.  Where all cells of a
row exceed one edit, so do those of every word with the same prefix; the scan goes on behind
them.

One list of all words would be one task.  Of two near words, the shorter of m letters, the
edit lies in the first or the second half; the other half stands in both.  So words are
listed with those of the same length m (or m + 1) and the same half, and lists above
``LIST`` words are split again in the same way, the half with the edit in two.
"""

import zlib
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import functions as F

from plyclock.llm.common import stored, text_slices

#: Words of a list above which it is split.
LIST = 2000
#: Letters of words.
LETTERS = "A-Za-zÀ-ÿ"


def word_counts(docs, text="text", key="doc_id", sparse=199, letters=6):
    """``word, n``: words of at least ``letters`` code points and how often they occur.

    Words are runs of letters with A-Z in lower case.  Where ``sparse`` divides the CRC-32
    of ``key:word``, the word lacks the letter at that CRC modulo its length; a null key
    takes no letter.  Null texts have no words; repeated rows count repeatedly.
    """

    def run(batches):
        import numpy as np
        import pyarrow.compute as pc

        crc32 = zlib.crc32
        for batch in batches:
            for at, texts in text_slices(batch.column("_text")):
                keys = batch.column("_key").slice(at, len(texts)).to_pylist()
                lowered = pc.ascii_lower(pc.fill_null(texts, "").cast(pa.large_string()))
                split = pc.ascii_split_whitespace(
                    pc.replace_substring_regex(lowered, f"[^{LETTERS}]+", " "))
                if isinstance(split, pa.ChunkedArray):
                    split = split.combine_chunks()
                coded = pc.dictionary_encode(split.flatten())
                distinct = coded.dictionary
                # A word that loses a letter is one letter shorter, so short ones never count.
                use = np.asarray(pc.utf8_length(distinct), np.int64) >= letters
                words = distinct.to_pylist()
                per_text = np.asarray(pc.list_value_length(split), np.int64)
                row = np.repeat(np.arange(len(per_text)), per_text)
                code = np.asarray(coded.indices, np.int64)
                mask = use[code]
                pairs, n = np.unique(row[mask] * max(1, len(words)) + code[mask], return_counts=True)
                row, code = np.divmod(pairs, max(1, len(words)))
                raw = [w.encode() for w in words]
                starts = [None if k is None else crc32(f"{k}:".encode()) for k in keys]
                # The CRC of the key is gone on with, word by word.
                crcs = np.array([1 if starts[r] is None else crc32(raw[c], starts[r])
                                 for r, c in zip(row.tolist(), code.tolist(), strict=True)], np.int64)
                hit = np.array([s is not None for s in starts], bool)[row] & (crcs % sparse == 0)
                whole = np.bincount(code[~hit], n[~hit], minlength=len(words)).astype(np.int64)
                out, counts = [words[i] for i in np.flatnonzero(whole)], whole[whole > 0].tolist()
                for i in np.flatnonzero(hit):
                    word, gone = words[code[i]], int(crcs[i]) % len(words[code[i]])
                    if len(word) > letters:
                        out.append(word[:gone] + word[gone + 1:])
                        counts.append(int(n[i]))
                yield pa.RecordBatch.from_pydict({"word": pa.array(out, pa.string()), "n": pa.array(counts, pa.int64())})

    return docs.select(docs[text].alias("_text"), docs[key].cast("string").alias("_key")) \
        .mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def near_in_list(words):
    """Pairs ``(i, j)``, i < j, of words in a sorted list of distinct words that are near."""
    for i, word in enumerate(words):
        size, far = len(word), 2
        # rows[d]: cells d - 1, d, d + 1 of the row after d letters of the other word.
        rows, before, j = [(far, 0, 1)], "", i + 1
        while j < len(words):
            other = words[j]
            if abs(len(other) - size) > 1:
                j += 1
                continue
            depth, most = 0, min(len(before), len(other), len(rows) - 1)
            while depth < most and before[depth] == other[depth]:
                depth += 1
            del rows[depth + 1:]
            before = other
            while depth < len(other):
                low, mid, high = rows[depth]
                c = other[depth]
                # Cells depth, depth + 1, depth + 2 of the next row.
                a = min(low + (depth < 1 or depth > size or word[depth - 1] != c), mid + 1) if depth else 1
                b = min(mid + (depth >= size or word[depth] != c), high + 1, a + 1)
                d = min(high + (depth + 1 >= size or word[depth + 1] != c), b + 1)
                if depth + 1 > size:
                    b = far
                if depth + 2 > size:
                    d = far
                depth += 1
                rows.append((a, b, d))
                if a > 1 and b > 1 and d > 1:
                    break
            row = rows[depth]
            if row[0] > 1 and row[1] > 1 and row[2] > 1:
                # So it is for all words that begin alike.
                j = bisect_left(words, other[:depth] + "\U0010ffff", j + 1)
                continue
            if row[size - depth + 1] == 1:
                yield i, j
            j += 1


def listed(words):
    """``of, m, i, j, key``: every word in its lists; ``key`` are its first i and last j letters."""
    sizes = F.array(F.col("size"), F.col("size") - 1)
    return words.select("word", F.length("word").alias("size")).select(
        "word", F.explode(sizes).alias("m")).withColumn("i", F.lit(0)).withColumn("j", F.lit(0))


def with_key(table):
    return table.withColumn("key", F.concat_ws(
        ":", "m", "i", F.expr("substring(word, 1, i)"), F.expr("right(word, j)")))


def split_again(table):
    """Every word in two lists more narrow: the letters in between halved, one half held."""
    held = F.expr("(m - i - j) div 2")
    return table.withColumn("_half", held).select(
        "word", "m", F.explode(F.array(
            F.struct((F.col("i") + F.col("_half")).cast("int").alias("i"), F.col("j").alias("j")),
            F.struct(F.col("i").alias("i"), (F.col("j") + F.col("_half")).cast("int").alias("j")))).alias("_n"),
    ).select("word", "m", "_n.i", "_n.j")


def near_words(words, most=LIST):
    """``word, other``: all pairs of near words of a table of distinct words, both ways round.

    A word of one letter has no two halves and is in one list with all of its length.
    """
    todo = split_again(listed(words))
    done = []
    while True:
        todo = stored(with_key(todo))
        sizes = todo.groupBy("key").agg(F.count("*").alias("_n"), F.min(F.expr("m - i - j")).alias("_rest"))
        large = stored(sizes.filter((F.col("_n") > most) & (F.col("_rest") > 1)).select("key"))
        if not large.limit(1).count():
            done.append(todo)
            break
        done.append(todo.join(large, "key", "left_anti"))
        todo = split_again(todo.join(large, "key", "left_semi"))
    lists = done[0]
    for more in done[1:]:
        lists = lists.unionByName(more)

    def run(batches):
        def pairs(words):
            return [(words[a], words[b]) for a, b in near_in_list(words)]

        held, key = [], None
        for batch in batches:
            out = []
            for k, w in zip(batch.column("key").to_pylist(), batch.column("word").to_pylist(), strict=True):
                if k != key:
                    out += pairs(held)
                    held, key = [], k
                held.append(w)
            yield pa.RecordBatch.from_pydict({"word": pa.array([a for a, _ in out], pa.string()),
                                              "other": pa.array([b for _, b in out], pa.string())})
        out = pairs(held)
        yield pa.RecordBatch.from_pydict({"word": pa.array([a for a, _ in out], pa.string()),
                                          "other": pa.array([b for _, b in out], pa.string())})

    found = lists.select("key", "word").repartition("key").sortWithinPartitions("key", "word") \
        .mapInArrow(run, "word string, other string").distinct()
    return found.select(F.explode(F.array(
        F.struct("word", "other"), F.struct(F.col("other").alias("word"), F.col("word").alias("other")))).alias("_p")) \
        .select("_p.*")


def roots(forms):
    """``word, root``: the end of the chain of forms for every word that has one.

    Forms have larger counts than their words, so chains end; each round doubles the
    step, so rounds go by the logarithm of the longest chain.
    """
    steps = forms.select("word", F.col("form").alias("root"))
    while True:
        steps = stored(steps)
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        further = steps.join(ahead, "root", "left")
        if not further.filter("_next IS NOT NULL").limit(1).count():
            return steps
        steps = further.select("word", F.coalesce("_next", "root").alias("root"))


def spelling_variants(docs, text="text", key="doc_id", sparse=199, letters=6, least=5, ratio=5):
    """``word, form, root, n, n_near, form_n`` of every word that occurs ``least`` times.

    ``form`` is the near word of largest ``n``, the first in code-point order of several,
    or null if it has not ``ratio`` times the word's own; ``root`` is the word itself where
    there is no form.  An empty table gives no rows; other columns are not looked at.
    """
    words = stored(word_counts(docs, text, key, sparse, letters).filter(F.col("n") >= least))
    near = near_words(words)
    counted = near.join(words.select(F.col("word").alias("other"), F.col("n").alias("_n")), "other")
    best = counted.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("_n")).alias("_n"), F.col("other"))).alias("_b"))
    chosen = F.coalesce(-F.col("_b._n") >= ratio * F.col("n"), F.lit(False))
    table = stored(words.join(best, "word", "left").select(
        "word", F.when(chosen, F.col("_b.other")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(chosen, -F.col("_b._n")).alias("form_n")))
    ends = roots(table.filter("form IS NOT NULL"))
    return table.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
