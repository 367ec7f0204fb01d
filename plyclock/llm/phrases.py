"""Mining of phrases whose words keep together, by counting in tiles of pairs.

The texts of a language are cut into pieces at punctuation and line ends and the pieces
into words.  Words that occur often enough get ids by falling frequency, and texts become
*slices*, arrays of ids of bounded length.  A phrase of k words is a pair: the phrase of
its first k - 1 words and its last word.  So phrases of every length are counted alike:

* The pairs of a slice lie in a plane whose axes are the two ids.  The plane is split
  into square tiles.  Tiles with many pairs, near the origin as ids go by frequency, are
  counted by direct address (``numpy.bincount``), all others as sorted coordinates.
* Counts are added up tile by tile over the slices, in rounds of bounded groups.
* Pairs that occur often enough get ids by falling frequency in turn, the slices are
  written anew with them, and the next length is counted.

No count passes a threshold early, so all counts are exact: a phrase can only be frequent
if the phrases within it are.  Only bounded bit maps of the frequent words and pairs are
collected and broadcast, to keep rare ones from being sent, and a few totals.
"""

import functools
import math

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from plyclock.llm.common import ranked, release, stored, text_slices

#: Bytes of text that make a slice.
SLICE_BYTES = 16_000_000
#: Ids along the side of a tile, as a power of two.
TILE = 9
#: A tile is counted by direct address if it has a pair for so many of its cells.
DENSE = 4
#: Counts of so many slices are added up at once.
TOGETHER = 256
#: Pairs of further slices are added to the sum when there are so many.
ADDED_PAIRS = 1_000_000
#: Tiles are dealt to bundles, one for so many words.
BUNDLE_WORDS = 1_000_000

#: Frequent words are dealt to lists of about so many.
LIST_WORDS = 20_000

#: Bits in the filter of frequent words or pairs for each of them, and in all at most.
FILTER_BITS, MOST_BITS = 16, 1 << 26

#: The marks that end a piece, and what lies between words.
ENDS, BETWEEN = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]+"


def words_of(texts):
    """All words of an Arrow column of texts: codes, their words, and where the breaks are.

    Codes are numbers into the words, -1 at every end of a piece or text.
    """
    import numpy as np
    import pyarrow.compute as pc

    lowered = pc.ascii_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    # A full stop is no word, so it can stand for every break.
    marked = pc.replace_substring_regex(lowered, ENDS + "+", " . ")
    split = pc.ascii_split_whitespace(marked)
    if isinstance(split, pa.ChunkedArray):
        split = split.combine_chunks()
    per_text = np.asarray(pc.list_value_length(split), np.int64)
    coded = pc.dictionary_encode(split.flatten())
    words = coded.dictionary.to_pylist()
    number = np.cumsum([w not in ("", ".") for w in words], dtype=np.int64) - 1
    number = np.array([-1 if w == "." else -2 if w == "" else i for w, i in zip(words, number, strict=True)], np.int32)
    at = np.arange(int(per_text.sum())) + np.repeat(np.arange(len(per_text)), per_text)
    codes = np.full(len(at) + len(per_text), -1, np.int32)
    if len(at):
        codes[at] = number[np.asarray(coded.indices)]
    return codes[codes > -2], [w for w in words if w not in ("", ".")]


def without_gaps(*arrays):
    """Arrays of ids cut short: of a run of positions without a word one is left."""
    import numpy as np

    gone = arrays[0] < 0
    keep = ~gone
    keep[:-1] |= gone[:-1] & ~gone[1:]
    return [np.ascontiguousarray(a[keep]) for a in arrays]


def slices_of(docs, text, lang):
    """``slice, lang, codes, words, counts``, one row per slice of one language."""

    def run(batches):
        import numpy as np
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        held, size = {}, 0

        def rows():
            nonlocal made
            for name, parts in held.items():
                codes, words = words_of(pa.concat_arrays(parts))
                counts = np.bincount(codes[codes >= 0], minlength=len(words))
                yield pa.RecordBatch.from_pydict({
                    "slice": pa.array([task << 30 | made], pa.int64()), "lang": pa.array([name], pa.string()),
                    "codes": pa.array([packed(codes)], pa.binary()),
                    "words": pa.array([words], pa.list_(pa.string())),
                    "counts": pa.array([counts], pa.list_(pa.int64()))})
                made += 1
            pa.default_memory_pool().release_unused()

        for batch in batches:
            for at, texts in text_slices(batch.column(text)):
                langs = batch.column(lang).slice(at, len(texts))
                for name in langs.unique().to_pylist():
                    some = texts.filter(pa.compute.equal(langs, name))
                    held.setdefault(name, []).append(some.cast(pa.large_string()))
                size += texts.nbytes
                if size >= SLICE_BYTES:
                    yield from rows()
                    held, size = {}, 0
        yield from rows()

    return docs.mapInArrow(
        run, "slice long, lang string, codes binary, words array<string>, counts array<long>")


@functools.cache
def zstandard_pair():
    """What compresses and what expands, once per process."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress


def packed(values, kind="i4"):
    """Integers as bytes, the lowest of all first, then the next, by zstandard.

    High bytes compress to nothing, and low ones as far as small ids are the frequent ones;
    a shuffle's own compression only looks for repeats.
    """
    import numpy as np

    values = np.ascontiguousarray(values, kind)
    return zstandard_pair()[0](values.view("u1").reshape(-1, values.itemsize).T.tobytes())


def ints(value, kind="i4"):
    import numpy as np

    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard_pair()[1](value), "u1").reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def packed_keys(keys):
    """Sorted keys by their differences."""
    import numpy as np

    return packed(np.diff(keys, prepend=np.int64(0)), "i8")


def keys_of(value):
    return ints(value, "i8").cumsum()


def rows_of(batch):
    """The rows of a batch one after another, as a slice is large.

    What one row took goes back to the system before the next, or idle workers would hold it.
    """
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]
        pa.default_memory_pool().release_unused()


def pair_counts(x, y, tile=TILE, dense=DENSE, tiles_at_once=8):
    """Distinct pairs as sorted keys ``x << 32 | y``, and the number of each."""
    import numpy as np

    x, y = x.astype(np.int64), y.astype(np.int64)
    cells, low = 1 << 2 * tile, (1 << tile) - 1
    # Only tiles near the origin can be dense; they are counted by number first.
    side = max(1, math.isqrt(len(x) * dense // cells + 1) * 8)
    near = np.flatnonzero((x >> tile < side) & (y >> tile < side))
    number = (x[near] >> tile) * side + (y[near] >> tile)
    full = np.flatnonzero(np.bincount(number, minlength=1) >= cells // dense)
    place = np.full(side * side, -1, np.int64)
    place[full] = np.arange(len(full))
    of = place[number]
    keys, counts = [], []
    for first in range(0, len(full), tiles_at_once):
        here = near[(of >= first) & (of < first + tiles_at_once)]
        hx, hy = x[here], y[here]
        cell = (place[(hx >> tile) * side + (hy >> tile)] - first) << 2 * tile | (hx & low) << tile | hy & low
        found = np.bincount(cell)
        at = np.flatnonzero(found)
        of_tile = full[first + (at >> 2 * tile)]
        keys.append(((of_tile // side << tile) + (at >> tile & low)) << 32 | (of_tile % side << tile) + (at & low))
        counts.append(found[at])
    rest = np.ones(len(x), bool)
    rest[near[of >= 0]] = False
    sparse = np.unique(x[rest] << 32 | y[rest], return_counts=True)
    keys, counts = np.concatenate([*keys, sparse[0]]), np.concatenate([*counts, sparse[1]])
    order = np.argsort(keys, kind="stable")
    return keys[order], counts[order]


def added_up(keys, counts):
    """Sorted distinct keys and the sum of the counts of each."""
    import numpy as np

    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    return keys[first], np.add.reduceat(counts, first)


def bundle_of(keys, bundles, tile=TILE):
    return ((keys >> 32 + tile) * 1_000_003 + (keys >> tile & (1 << 32 - tile) - 1) * 7919) % bundles


def extended(words, left, length):
    """Positions where a phrase of ``length`` may start: ``left`` there and next to it, and the pair."""
    import numpy as np

    n = max(0, len(words) - length + 1)
    x, y = left[:n], words[len(words) - n:]
    at = np.flatnonzero((x >= 0) & (y >= 0) & (left[1:n + 1] >= 0))
    return at, x[at], y[at]


def ids_of(row):
    """The words of a slice and the phrases that start at each; single words are their own."""
    words = ints(row["words"])
    return words, words if row["lefts"] is None else ints(row["lefts"])


def bundled_pairs(x, y, bundles):
    """The pairs of a slice by bundle: keys, counts, and per bundle its number, start and end."""
    import numpy as np

    keys, counts = pair_counts(x, y)
    of = bundle_of(keys, bundles)
    order = np.argsort(of, kind="stable")
    of = of[order]
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    return keys[order], counts[order], list(zip(
        of[starts].tolist(), starts.tolist(), np.append(starts, len(of))[1:].tolist(), strict=True))


def place_of_pair(x, y, bits):
    """Place of a pair in a filter; ids stay below 2^31, so nothing overflows."""
    return (x * 1_000_003 + y * 7919) % bits


def place_of_word(crc, bits):
    return crc % bits


def frequent_filter(table, place):
    """A bit map of the rows of ``table``, broadcast; ``place`` makes a column of the number of bits.

    Sized by the rows up to ``MOST_BITS``.  What it lets through by chance falls out in the
    join behind it, so nothing but traffic depends on it.
    """
    import numpy as np

    bits = min(MOST_BITS, 1 << max(12, (FILTER_BITS * table.count()).bit_length()))
    # One row per 64 places, so no more than MOST_BITS / 64 of them.
    held = table.select(place(bits).alias("place")).groupBy(F.floor(F.col("place") / 64).alias("at")).agg(
        F.expr("bit_or(shiftleft(1L, int(place % 64)))").alias("bits")).collect()
    bitmap = np.zeros(bits // 64, np.int64)
    for r in held:
        bitmap[r["at"]] = r["bits"]
    return table.sparkSession.sparkContext.broadcast(bitmap)


def is_set(bitmap, places):
    return (bitmap[places >> 6] >> (places & 63)) & 1 == 1


def counts_of_slices(slices, length, bundles):
    """``slice, bundle, keys, counts`` of all pairs that make a phrase of ``length``."""

    def run(batches):
        for batch in batches:
            for r in rows_of(batch):
                _, x, y = extended(*ids_of(r), length)
                keys, counts, parts = bundled_pairs(x, y, bundles)
                yield pa.RecordBatch.from_pydict({
                    "slice": pa.array([r["slice"]] * len(parts), pa.int64()),
                    "bundle": pa.array([of for of, _, _ in parts], pa.int64()),
                    "keys": pa.array([packed_keys(keys[a:b]) for _, a, b in parts], pa.binary()),
                    "counts": pa.array([packed(counts[a:b], "i8") for _, a, b in parts], pa.binary())})

    return slices.mapInArrow(run, "slice long, bundle long, keys binary, counts binary")


def frequent_pairs(met, n_slices, least):
    """``bundle, x, y, f``: pairs with ``least`` occurrences in all slices.

    Slices are added up in rounds of about ``TOGETHER``, so no group grows with the input.
    """
    import numpy as np

    def total(table):
        columns = table.select(["keys", "counts"]).to_pydict()
        # Added up as they come, so that little more than the distinct pairs is held.
        held, more = [(np.empty(0, np.int64), np.empty(0, np.int64))], 0
        for k, c in zip(columns["keys"], columns["counts"], strict=True):
            held.append((keys_of(k), ints(c, "i8")))
            more += len(held[-1][0])
            if more > ADDED_PAIRS:
                held, more = [added_up(*map(np.concatenate, zip(*held, strict=True)))], 0
        return added_up(*map(np.concatenate, zip(*held, strict=True)))

    def merge(table):
        keys, counts = total(table)
        return pa.table({"bundle": table.column("bundle")[:1], "slice": table.column("part")[:1],
                         "keys": pa.array([packed_keys(keys)], pa.binary()),
                         "counts": pa.array([packed(counts, "i8")], pa.binary())})

    def finish(table):
        keys, counts = total(table)
        use = counts >= least
        keys = keys[use]
        return pa.table({"bundle": pa.array(np.full(len(keys), table.column("bundle")[0].as_py()), pa.int64()),
                         "x": pa.array(keys >> 32), "y": pa.array(keys & 0xFFFFFFFF), "f": pa.array(counts[use])})

    parts = n_slices
    while parts > TOGETHER:
        parts = -(-parts // TOGETHER)
        met = met.withColumn("part", F.pmod(F.xxhash64("slice"), F.lit(parts))).groupBy("bundle", "part") \
            .applyInArrow(merge, "bundle long, slice long, keys binary, counts binary")
    return met.groupBy("bundle").applyInArrow(finish, "bundle long, x long, y long, f long")


def with_phrases(slices, met, pairs, length, bundles):
    """The slices with the ids of ``pairs`` in place of those of their first parts.

    A slice gets the ids of its frequent pairs bundle by bundle, and bits that tell which of
    its pairs, less those that a filter knows to be rare, they are; the pairs themselves it
    finds again, in the order of ``met``.
    """
    import numpy as np

    def gathered(table):
        keys = np.asarray(table.column("x")) << 32 | np.asarray(table.column("y"))
        order = np.argsort(keys)
        return pa.table({"bundle": table.column("bundle")[:1],
                         "known": pa.array([packed_keys(keys[order])], pa.binary()),
                         "ids": pa.array([packed(np.asarray(table.column("id"))[order])], pa.binary())})

    wanted = frequent_filter(pairs, lambda bits: place_of_pair(F.col("x"), F.col("y"), bits))

    def likely(keys):
        return is_set(wanted.value, place_of_pair(keys >> 32, keys & 0xFFFFFFFF, 64 * len(wanted.value)))

    def sifted(batches):
        for batch in batches:
            keys = [keys_of(k) for k in batch.column("keys").to_pylist()]
            keys = [k[likely(k)] for k in keys]
            use = pa.array([len(k) > 0 for k in keys], pa.bool_())
            kept = batch.select(["slice", "bundle"]).filter(use)
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array([packed_keys(k) for k in keys if len(k)], pa.binary())],
                names=["slice", "bundle", "keys"])

    def chosen(batches):
        for batch in batches:
            out = {"slice": [], "bundle": [], "bits": [], "ids": []}
            for r in rows_of(batch):
                known, keys = keys_of(r["known"]), keys_of(r["keys"])
                place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                frequent = known[place] == keys
                if frequent.any():
                    out["slice"].append(r["slice"])
                    out["bundle"].append(r["bundle"])
                    out["bits"].append(np.packbits(frequent).tobytes())
                    out["ids"].append(packed(ints(r["ids"])[place[frequent]]))
            yield pa.RecordBatch.from_pydict({
                "slice": pa.array(out["slice"], pa.int64()), "bundle": pa.array(out["bundle"], pa.int64()),
                "bits": pa.array(out["bits"], pa.binary()), "ids": pa.array(out["ids"], pa.binary())})

    def renamed(batches):
        for batch in batches:
            for r in rows_of(batch):
                words, left = ids_of(r)
                at, x, y = extended(words, left, length)
                pairs, _, parts = bundled_pairs(x, y, bundles)
                ids = np.full(len(pairs), -1, np.int32)
                place_of = {of: (a, b) for of, a, b in parts}
                let_through = likely(pairs)
                for p in r["pairs"]:
                    a, b = place_of[p["bundle"]]
                    of = a + np.flatnonzero(let_through[a:b])
                    bits = np.unpackbits(np.frombuffer(p["bits"], "u1"), count=len(of)).astype(bool)
                    ids[of[bits]] = ints(p["ids"])
                order = np.argsort(pairs)
                pairs, ids = pairs[order], ids[order]
                named = ids[np.searchsorted(pairs, x.astype(np.int64) << 32 | y)]
                known = named >= 0
                new = np.full(len(words), -1, np.int32)
                new[at[known]] = named[known]
                # A word outside of every frequent phrase of this length is in no longer one.
                inside = np.zeros(len(words) + 1, np.int64)
                np.add.at(inside, at[known], 1)
                np.add.at(inside, at[known] + length, -1)
                words = np.where(np.cumsum(inside[:-1]) > 0, words, -1).astype(np.int32)
                words, new = without_gaps(words, new)
                yield pa.RecordBatch.from_pydict({
                    "slice": pa.array([r["slice"]], pa.int64()), "words": pa.array([packed(words)], pa.binary()),
                    "lefts": pa.array([packed(new)], pa.binary())})

    found = pairs.groupBy("bundle").applyInArrow(gathered, "bundle long, known binary, ids binary")
    likely_met = met.select("slice", "bundle", "keys").mapInArrow(sifted, "slice long, bundle long, keys binary")
    named = stored(likely_met.join(found, "bundle").mapInArrow(
        chosen, "slice long, bundle long, bits binary, ids binary"))
    release(met)
    per_slice = named.groupBy("slice").agg(F.collect_list(F.struct("bundle", "bits", "ids")).alias("pairs"))
    result = stored(slices.join(per_slice, "slice").mapInArrow(renamed, "slice long, words binary, lefts binary"))
    release(slices, named)
    return result


def with_words(raw, vocabulary, lists):
    """``slice, words, lefts``: the slices with the ids of the frequent words, -1 elsewhere.

    ``lefts`` is null, as the phrases of one word are the words.  The words of a slice meet the vocabulary in ``lists`` by their CRC-32,
    not one by one, and only those that a filter takes for frequent.
    """
    import zlib

    import numpy as np

    wanted = frequent_filter(vocabulary, lambda bits: place_of_word(F.crc32(F.col("phrase").cast("binary")), bits))

    def dealt(batches):
        for batch in batches:
            for r in rows_of(batch):
                crc = np.array([zlib.crc32(w.encode()) for w in r["words"]], np.int64)
                use = is_set(wanted.value, place_of_word(crc, 64 * len(wanted.value)))
                of = np.where(use, crc % lists, -1)
                for number in np.unique(of[use]):
                    at = np.flatnonzero(of == number)
                    yield pa.RecordBatch.from_pydict({
                        "slice": pa.array([r["slice"]], pa.int64()), "lang": pa.array([r["lang"]], pa.string()),
                        "list": pa.array([int(number)], pa.int64()), "codes": pa.array([packed(at)], pa.binary()),
                        "words": pa.array([[r["words"][i] for i in at]], pa.list_(pa.string()))})

    def gathered(table):
        return pa.table({
            "lang": table.column("lang")[:1], "list": table.column("list")[:1],
            "known": pa.array([table.column("phrase").to_pylist()], pa.list_(pa.string())),
            "ids": pa.array([packed(np.asarray(table.column("id")))], pa.binary())})

    def chosen(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                place = pa.compute.index_in(row.column("words").flatten(), value_set=row.column("known").flatten())
                use = np.asarray(place.is_valid())
                codes, ids = (ints(row.column(c)[0].as_py()) for c in ("codes", "ids"))
                yield pa.RecordBatch.from_pydict({
                    "slice": row.column("slice"), "codes": pa.array([packed(codes[use])], pa.binary()),
                    "ids": pa.array([packed(ids[np.asarray(place.drop_null())])], pa.binary())})

    def translated(batches):
        for batch in batches:
            for r in rows_of(batch):
                # The last place is for the breaks, whose code is -1.
                ids = np.full(r["size"] + 1, -1, np.int32)
                for w in r["known"]:
                    ids[ints(w["codes"])] = ints(w["ids"])
                found, = without_gaps(ids[ints(r["codes"])])
                yield pa.RecordBatch.from_pydict({
                    "slice": pa.array([r["slice"]], pa.int64()), "words": pa.array([packed(found)], pa.binary()),
                    "lefts": pa.array([None], pa.binary())})

    known = vocabulary.withColumn("list", F.crc32(F.col("phrase").cast("binary")) % lists) \
        .groupBy("lang", "list").applyInArrow(gathered, "lang string, list long, known array<string>, ids binary")
    named = stored(raw.select("slice", "lang", "words").mapInArrow(
        dealt, "slice long, lang string, list long, codes binary, words array<string>")
        .join(known, ["lang", "list"]).mapInArrow(chosen, "slice long, codes binary, ids binary"))
    per_slice = named.groupBy("slice").agg(F.collect_list(F.struct("codes", "ids")).alias("known"))
    result = stored(raw.select("slice", "codes", F.size("words").alias("size")).join(per_slice, "slice")
                    .mapInArrow(translated, "slice long, words binary, lefts binary"))
    release(named)
    return result


def frequent_phrases(docs, text="text", lang="lang", least=100, longest=5):
    """``lang, phrase, k, f``: all phrases of 1 to ``longest`` words that occur ``least`` times
    in their language, and ``lang, n``, the number of its words.

    A null text is empty; a null language is ``und``; repeated rows count repeatedly.
    """
    docs = docs.select(docs[text].alias("text"), F.coalesce(docs[lang], F.lit("und")).alias("lang"))
    raw = stored(slices_of(docs, "text", "lang"))
    words = raw.select("slice", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "_w")) \
        .select("slice", "lang", "code", F.col("_w.words").alias("phrase"), F.col("_w.counts").alias("n"))
    totals = stored(words.groupBy("lang").agg(F.sum("n").alias("n")))
    n_slices, n_words = raw.count(), totals.agg(F.sum("n")).first()[0] or 0
    bundles = max(1, math.ceil(n_words / BUNDLE_WORDS))
    frequent = words.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    vocabulary = ranked(frequent, F.desc("f"), "lang", "phrase")

    lists = max(1, math.ceil(vocabulary.count() / LIST_WORDS))
    slices = with_words(raw, vocabulary, lists)
    release(raw)

    named = vocabulary.select("id", "lang", "phrase", "f")
    every = [named.withColumn("k", F.lit(1))]
    last = named.select(F.col("id").alias("y"), F.col("phrase").alias("_last"))
    for length in range(2, longest + 1):
        met = stored(counts_of_slices(slices, length, bundles))
        pairs = ranked(frequent_pairs(met, n_slices, least), F.desc("f"), "x", "y")
        first = named.select(F.col("id").alias("x"), "lang", F.col("phrase").alias("_first"))
        named = stored(pairs.join(first, "x").join(last, "y").select(
            "id", "lang", F.concat_ws(" ", "_first", "_last").alias("phrase"), "f"))
        every.append(named.withColumn("k", F.lit(length)))
        if length < longest:
            slices = with_phrases(slices, met, pairs, length, bundles)
        else:
            release(slices, met)
        release(pairs)
    table = every[0]
    for more in every[1:]:
        table = table.unionByName(more)
    return stored(table.drop("id")), totals


def mine_phrases(docs, text="text", lang="lang", least=100, longest=5, top=2000):
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Candidates are phrases of 2 to ``longest`` words with ``a >= least`` occurrences, less
    those that lie within a longer candidate with as many.  A phrase is cut in two where
    ``floor(1000 a n / (l r))`` is least, the first such place of several; that is its
    score.  Order: score and a descending, then the phrase by its UTF-8 bytes.  An empty
    table, or one without frequent phrases, gives no rows; other columns are not looked at.
    """
    every, totals = frequent_phrases(docs, text, lang, least, longest)
    candidates = every.filter("k > 1")
    # A longer phrase with as many occurrences has one longer by one word with as many between.
    within = every.filter("k > 2").select("lang", F.explode(F.array(
        F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substring_index(phrase, ' ', 1 - k)"),
    )).alias("phrase"), F.col("f").alias("_f")).groupBy("lang", "phrase").agg(F.max("_f").alias("_f"))
    left = candidates.join(within, ["lang", "phrase"], "left").filter(F.expr("coalesce(_f < f, true)")).drop("_f")
    cuts = left.select("lang", "phrase", "f", "k", F.explode(F.expr("sequence(1, k - 1)")).alias("cut")).selectExpr(
        "lang", "phrase", "f AS a", "cut", "substring_index(phrase, ' ', cut) AS _first",
        "substring_index(phrase, ' ', cut - k) AS _rest")
    one = every.select("lang", F.col("phrase").alias("_first"), F.col("f").alias("l"))
    two = every.select("lang", F.col("phrase").alias("_rest"), F.col("f").alias("r"))
    scored = cuts.join(one, ["lang", "_first"]).join(two, ["lang", "_rest"]).join(totals, "lang").withColumn(
        "score", F.expr("(cast(1000 * a as decimal(19, 0)) * cast(n as decimal(19, 0))) "
                        "div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"))
    worst = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("_c"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return worst.select("lang", "phrase", "a", "_c.l", "_c.r", "n", "_c.score").withColumn(
        "rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
