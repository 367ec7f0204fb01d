"""Language identification by unigrams of pieces, summed over all segmentations.

The pieces are the tokens of a fixed public vocabulary, all of them, where a token that
ends a word carries the blank behind it.  A language is one
probability per piece.  A word's probability is the sum over every way of cutting it
into pieces, found by the forward algorithm, and a text's is the product over its
words.  The probabilities are learned by expectation maximisation: expected counts of
every piece over all segmentations, by the forward and backward sums.

Words are scored in whole batches: equal words once, and one step of the recursion for
all words at a time.  Words of any length are scored whole; the sums are scaled as they
go, so they do not vanish.  Only where probabilities are learned are words cut at every
``RUN_BYTES``, as the backward sums need the whole lattice of a word at once.
"""

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plyclock.llm.common import free_name, give_back, surely_least, text_slices
from plyclock.llm.tokens import forget_encoders, tokenizer_path

#: The hash of a piece is a polynomial of its bytes in this odd number, modulo 2^64.
FACTOR = 0x9E6C63D0876A9A99
#: Longer words are learned from as runs of so many bytes, one after the other.
RUN_BYTES = 48
#: The sums of a word are scaled after so many bytes.
SCALED = 16
#: Bytes of text looked at together; a word takes hundreds of bytes while its text is scored.
TEXT_BYTES = 2_000_000
#: Documents of each language that the probabilities are learned from.
SAMPLE = 900
ROUNDS = 4
#: Share of every language's mass that is spread evenly over all pieces.
EVEN = 1e-4
UNDETERMINED = "und"


class Pieces:
    """The vocabulary as hash tables, one for each length, from hashes to piece numbers."""

    def __init__(self, path=None):
        import json

        import numpy as np

        with open(path or tokenizer_path(), encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        same = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(same)]
        byte = {chr(b): b for b in same} | {chr(256 + i): b for i, b in enumerate(rest)}
        found = set()
        for token in vocabulary:
            ends = token.endswith("</w>")
            raw = bytes(byte[c] for c in (token[:-4] if ends else token)) + (b" " if ends else b"")
            if raw:
                found.add(raw)
        found |= {bytes([b]) for b in range(256)}
        self.pieces = sorted(found, key=lambda p: (len(p), p))
        self.longest = len(self.pieces[-1])
        self.powers = np.array([pow(FACTOR, d, 1 << 64) for d in range(self.longest)], np.uint64)
        self.tables = {}
        for size in range(1, self.longest + 1):
            of = [(self.hashed(p), i) for i, p in enumerate(self.pieces) if len(p) == size]
            if len({k for k, _ in of}) < len(of):
                raise AssertionError("two pieces have one hash")
            if of:
                self.tables[size] = self.table(np.array([k for k, _ in of], np.uint64),
                                               np.array([i for _, i in of], np.int32))

    def hashed(self, piece):
        """As ``ending_at`` makes it: the last byte first."""
        return sum((b + 1) * pow(FACTOR, d, 1 << 64) for d, b in enumerate(reversed(piece))) % (1 << 64)

    @staticmethod
    def slots(keys, bits):
        import numpy as np

        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def table(self, keys, numbers):
        """Open addressing, as many probes as the longest run needs."""
        import numpy as np

        bits = max(4, int(np.ceil(np.log2(4 * len(keys)))))
        held = np.zeros(1 << bits, np.uint64)
        value = np.full(1 << bits, -1, np.int32)
        probes = 1
        for key, number, slot in zip(keys, numbers, self.slots(keys, bits).tolist(), strict=True):
            tries = 1
            while value[slot] >= 0:
                slot, tries = (slot + 1) % (1 << bits), tries + 1
            held[slot], value[slot], probes = key, number, max(probes, tries)
        return bits, held, value, probes

    def look_up(self, size, keys):
        import numpy as np

        if size not in self.tables:
            return np.full(len(keys), -1, np.int32)
        bits, held, value, probes = self.tables[size]
        slot = self.slots(keys, bits)
        out = np.where(held[slot] == keys, value[slot], np.int32(-1))
        for _ in range(probes - 1):
            slot = (slot + 1) & ((1 << bits) - 1)
            open_ = np.flatnonzero((out < 0) & (value[slot] >= 0))
            if not len(open_):
                continue
            hit = open_[held[slot[open_]] == keys[open_]]
            out[hit] = value[slot[hit]]
        return out

    def letters(self, words):
        """(order, lengths, bytes): words by falling length, so those with a byte j come first."""
        import numpy as np

        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        width = int(lengths[0]) if len(words) else 0
        letters = np.zeros((len(words), width), np.uint8)
        flat = np.frombuffer(b"".join([words[i] for i in order.tolist()]), np.uint8)
        letters[np.arange(width) < lengths[:, None]] = flat
        return order, lengths, np.ascontiguousarray(letters.T)

    def ending_at(self, letters, j, n):
        """Pieces that end at byte j of the first n words, by length; -1 for none."""
        import numpy as np

        key, pieces = np.zeros(n, np.uint64), []
        for d in range(1, min(self.longest, j + 1) + 1):
            key = key + (letters[j - d + 1, :n].astype(np.uint64) + np.uint64(1)) * self.powers[d - 1]
            pieces.append(self.look_up(d, key))
        return pieces

    def lattice(self, words):
        """(order, lengths, at[j][d]): pieces that end at byte j of each word, by length."""
        import numpy as np

        order, lengths, letters = self.letters(words)
        return order, lengths, [
            self.ending_at(letters, j, int(np.searchsorted(-lengths, -j, side="left"))) for j in range(len(letters))]

    def forward(self, lattice, chances):
        """Sums over segmentations: ``alpha[j]`` has one row per word and language.

        ``chances`` is pieces by languages, with a last row of zeros for "no piece".
        """
        import numpy as np

        _, lengths, columns = lattice
        alpha = [np.ones((len(lengths), chances.shape[1]))]
        for j, pieces in enumerate(columns):
            n = len(pieces[0])
            total = alpha[j][:n] * chances[pieces[0]]
            for d in range(1, len(pieces)):
                use = np.flatnonzero(pieces[d] >= 0)
                if len(use):
                    total[use] += alpha[j - d][use] * chances[pieces[d][use]]
            alpha.append(total)
        return alpha

    def scores(self, words, chances):
        """Log-probability of each word, a row per word and a column per language.

        Holds the sums of the last few bytes only, as far back as a piece can reach.
        """
        from collections import deque

        import numpy as np

        order, lengths, letters = self.letters(words)
        languages = chances.shape[1]
        out, scale = np.zeros((len(words), languages)), np.zeros((len(words), languages))
        recent = deque([np.ones((len(words), languages))], maxlen=self.longest)
        longer = [int(np.searchsorted(-lengths, -j, side="left")) for j in range(len(letters) + 1)]
        for j in range(len(letters)):
            n = longer[j]
            pieces = self.ending_at(letters, j, n)
            total = recent[0][:n] * chances[pieces[0]]
            for d in range(1, len(pieces)):
                use = np.flatnonzero(pieces[d] >= 0)
                if len(use):
                    total[use] += recent[d][use] * chances[pieces[d][use]]
            recent.appendleft(total)
            if j % SCALED == SCALED - 1:
                by = np.maximum(total, 1e-300)
                recent = deque([a[:n] / by for a in recent], maxlen=self.longest)
                scale[:n] += np.log(by)
            ended = slice(longer[j + 1], n)
            out[order[ended]] = np.log(np.maximum(recent[0][ended], 1e-300)) + scale[ended]
        return out

    def expected_counts(self, words, weights, chances):
        """How often each piece is used over all segmentations, for one language."""
        import numpy as np

        lattice = self.lattice(words)
        order, lengths, columns = lattice
        alpha = self.forward(lattice, chances[:, None])
        beta = [np.zeros(len(a)) for a in alpha]
        for size in np.unique(lengths).tolist():
            beta[size][lengths[:len(beta[size])] == size] = 1.0
        counts = np.zeros(len(chances))
        whole = np.empty(len(words))
        for size in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == size)
            whole[rows] = alpha[size][rows, 0]
        share = np.asarray(weights, float)[order] / np.maximum(whole, 1e-300)
        for j in range(len(columns) - 1, -1, -1):
            for d, piece in enumerate(columns[j]):
                use = np.flatnonzero(piece >= 0)
                if len(use):
                    step = chances[piece[use]] * beta[j + 1][use]
                    counts += np.bincount(
                        piece[use], alpha[j - d][use, 0] * step * share[use], len(chances))
                    beta[j - d][use] += step
        return counts


def in_parts(words, most=10_000, letters=500_000):
    """Words by length in parts of so many words, and of so many bytes if all were as long as the last."""
    part = []
    for word in words:
        if part and (len(part) >= most or (len(part) + 1) * (len(word) + 1) > letters):
            yield part
            part = []
        part.append(word)
    if part:
        yield part


def runs_of(word):
    """A word with its end mark, in runs short enough for the recursion."""
    word = word + b" "
    return [word[i:i + RUN_BYTES] for i in range(0, len(word), RUN_BYTES)]


def learn(pieces, counts, rounds=ROUNDS):
    """Piece probabilities of one language from its word counts."""
    import numpy as np

    runs = {}
    for word, n in counts.items():
        for run in runs_of(word):
            runs[run] = runs.get(run, 0) + n
    words, weights = list(runs), np.array(list(runs.values()), float)
    size = len(pieces.pieces)
    chances = np.append(np.array([300.0 ** -len(p) for p in pieces.pieces]), 0.0)
    chances[:size] /= chances[:size].sum()
    for _ in range(rounds):
        used = np.zeros(size + 1)
        for at in range(0, len(words), 10_000):
            used += pieces.expected_counts(words[at:at + 10_000], weights[at:at + 10_000], chances)
        total = used.sum() or 1.0
        chances[:size] = (1 - EVEN) * used[:size] / total + EVEN / size
    return chances[:size]


def word_list(texts):
    """Lower-case words of an Arrow column: (codes, words per text, distinct words)."""
    import pyarrow.compute as pc

    split = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string())))
    coded = pc.dictionary_encode(split.flatten())
    return coded, pc.list_value_length(split), coded.dictionary.cast(pa.large_binary()).to_pylist()


def training_rows(docs, sample=SAMPLE):
    """Up to ``sample`` labelled documents of each language, chosen by a hash of the id.

    The least hashes are taken, and repeated rows once.  The ids of a language are counted first, so that only about
    twice the sample goes to the task that ranks it, however common the language is.
    """
    usable = docs.filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").select(
        "doc_id", "lang", F.xxhash64("doc_id").alias("_h"))
    # Repeated ids lie on one hash, so it is the distinct ones that are counted.
    sizes = usable.groupBy("lang").agg(F.count_distinct("doc_id").alias("_size"))
    # One row a language, as the model has; the join must not deal the rows by language.
    ranked = usable.join(F.broadcast(sizes), "lang").filter(surely_least("_h", sample, F.col("_size"))) \
        .dropDuplicates(["lang", "doc_id"])
    window = Window.partitionBy("lang").orderBy("_h", "doc_id")
    chosen = ranked.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") <= sample)
    # At most ``sample`` rows a language, of two short columns.
    return docs.select("doc_id", "lang", "text").join(
        F.broadcast(chosen.select("doc_id", "lang")), ["doc_id", "lang"], "left_semi") \
        .dropDuplicates(["doc_id", "lang", "text"])


def fit_languages(docs, path=None, sample=SAMPLE, rounds=ROUNDS):
    """``{language: probabilities of the pieces}`` from the labelled rows of ``docs``.

    The bound on what is learned from is ``sample`` documents of each language; each
    language is fitted in one task.  No labelled row at all gives an empty model.
    """
    def fit(table):
        from collections import Counter

        import numpy as np

        forget_encoders()
        counts = Counter()
        for at, texts in text_slices(table.column("text").combine_chunks(), TEXT_BYTES):
            coded, _, words = word_list(texts)
            found = np.bincount(np.asarray(coded.indices), minlength=len(words))
            for word, n in zip(words, found.tolist(), strict=True):
                if word:
                    counts[word] += n
        chances = learn(Pieces(path), counts, rounds)
        counts.clear()
        give_back()
        return pa.table({"lang": [table.column("lang")[0].as_py()],
                         "chances": pa.array([chances.astype("<f8").tobytes()], pa.binary())})

    import numpy as np

    rows = training_rows(docs, sample).select("lang", "text").groupBy("lang").applyInArrow(
        fit, "lang string, chances binary").collect()
    return {r.lang: np.frombuffer(r.chances, "<f8") for r in sorted(rows, key=lambda r: r.lang)}


def identify(docs, model, path=None, text="text", remembered=300_000, label="lang_pred", score="score"):
    """Add ``lang_pred`` and ``score``, or what they are named instead, to every row.

    ``score`` is the share of the predicted language among all, from the probabilities
    of the whole text.  A null text and one without any letter get "und" and 0, as does
    every text under an empty model; equal languages go to the first by name.  Repeated rows
    stay repeated.  A table that has one of the two names already raises.
    """
    import numpy as np

    for name in (label, score):
        if free_name(docs, name) != name:
            raise ValueError(f"the table already has a column {name}")

    names = list(model)
    width = len(names)
    chances = np.zeros((len(next(iter(model.values()))) + 1, width)) if names else None
    for i, name in enumerate(names):
        chances[:-1, i] = model[name]
    sent = docs.sparkSession.sparkContext.broadcast(chances)
    schema = T.StructType([*docs.schema, T.StructField(label, T.StringType()),
                           T.StructField(score, T.DoubleType())])
    keep = docs.columns
    added = [label, score]

    def run(batches):
        import pyarrow.compute as pc

        forget_encoders()
        pieces, chances = Pieces(path), sent.value
        known, table = {b"": 0}, np.zeros((1, width))
        for batch in batches:
            for at, texts in text_slices(batch.column(text), TEXT_BYTES):
                size = len(texts)
                lettered = np.asarray(pc.fill_null(
                    pc.match_substring_regex(texts, r"\pL"), False))
                found = np.full(size, UNDETERMINED, dtype=object)
                sure = np.zeros(size)
                if width and lettered.any():
                    coded, per_text, words = word_list(texts)
                    if len(known) + len(words) > remembered:
                        known, table = {b"": 0}, np.zeros((1, width))
                    new = [w for w in words if w not in known]
                    if new:
                        # By length, so that a long word stands in no table of short ones.
                        new.sort(key=len)
                        got = [pieces.scores([w + b" " for w in part], chances) for part in in_parts(new)]
                        known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                        table = np.concatenate([table, *got])
                    number = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                    of_word = table[number[np.asarray(coded.indices)]]
                    ends = np.cumsum(np.asarray(per_text, dtype=np.int64))
                    sums = np.concatenate([np.zeros((1, width)), np.cumsum(of_word, axis=0)])
                    total = np.diff(sums[np.concatenate([[0], ends])], axis=0)
                    best = total.argmax(axis=1)
                    share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                    found[lettered] = np.array(names, dtype=object)[best[lettered]]
                    sure[lettered] = share[lettered]
                part = batch.slice(at, size)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(found.tolist(), pa.string()), pa.array(sure)],
                    names=[*keep, *added])
            give_back()

    return docs.mapInArrow(run, schema)
