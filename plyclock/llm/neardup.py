"""Near duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A document's set is its distinct shingles of five words.  Its signature has
``CHUNKS * WIDTH`` positions, each the 16 bits left of one minimum.  Two sets of
similarity s differ in a position with probability 1 - s, so pairs at 0.75 differ in a
quarter of them; all but about three in a million differ in ``DISTANCE`` at most.

*Pigeonhole.*  ``DISTANCE`` errors over ``CHUNKS`` chunks leave one chunk with
``DISTANCE // CHUNKS`` = 1 error or none.  Every signature is therefore filed under
each chunk with each one position left out, which enumerates the allowed errors: all
pairs within the distance meet under some key.

*What is compared.*  Equal sets are one class from the start.  Under each key every
class first meets the smallest class of that key, and only its nearest such meeting
is confirmed on the full sets.  What that links is joined to components.  Keys whose
classes are by then all in one component have nothing more to tell.  Under the
others, classes of different components are compared in blocks of bounded size, and
every pair within the distance is confirmed on the full sets there and then.  No link
between two components can be missed, and no pair leaves its block but those that
join components.
"""

import pyarrow as pa
from pyspark.sql import functions as F

from plyclock.llm.common import stored, text_slices, with_row_key

WORDS = 5
CHUNKS, WIDTH = 18, 4
DISTANCE = 35
SIMILARITY = (75, 100)
#: Members of a key that one task compares at a time.
BLOCK = 2048


def shingle_sets(texts):
    """For each text of an Arrow column its sorted distinct shingle hashes (64 bits)."""
    import numpy as np
    import pyarrow.compute as pc
    import xxhash

    low = pc.ascii_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    split = pc.ascii_split_whitespace(low)
    if isinstance(split, pa.ChunkedArray):
        split = split.combine_chunks()
    counts = np.asarray(pc.list_value_length(split), dtype=np.int64)
    coded = pc.dictionary_encode(split.flatten())
    digest = xxhash.xxh3_64_intdigest
    hashes = np.array([digest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()],
                      dtype=np.uint64)
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    codes = np.asarray(coded.indices)
    if empty >= 0:  # white space at an end of a text leaves an empty word
        real = codes != empty
        row = np.repeat(np.arange(len(counts)), counts)[real]
        codes, counts = codes[real], np.bincount(row, minlength=len(counts))
    words = hashes[codes]
    prime = np.uint64(0x9E3779B97F4A7C15)
    rolled = mixed(words)
    n = max(0, len(words) - WORDS + 1)
    five = rolled[:n].copy()
    for k in range(1, WORDS):
        five = five * prime + rolled[k:k + n]
    five = mixed(five)
    ends = np.cumsum(counts)
    for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
        if count >= WORDS:
            yield np.unique(five[end - count:end - WORDS + 1])
        elif count:
            whole = np.uint64(count)
            for w in rolled[end - count:end]:
                whole = np.uint64((int(whole) * int(prime) + int(w)) & 0xFFFFFFFFFFFFFFFF)
            yield mixed(np.array([whole], dtype=np.uint64))
        else:
            yield np.empty(0, dtype=np.uint64)


def mixed(x):
    """A bijection of 64-bit values that spreads every bit."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_seeds():
    import numpy as np

    at = np.arange(1, CHUNKS * WIDTH + 1, dtype=np.uint64)
    return mixed(at), mixed(at << np.uint64(20)) | np.uint64(1)


def signature(values, seeds, block=4096):
    """The 16-bit positions of a set's signature."""
    import numpy as np

    flip, times = seeds
    least = np.full(len(flip), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(values), block):
        np.minimum(least, ((values[at:at + block, None] ^ flip) * times).min(axis=0), out=least)
    return (mixed(least) >> np.uint64(48)).astype(np.uint16)


def described(docs):
    """``doc_id, text_hash, n_shingles, digest, sig`` of every document."""
    def run(batches):
        import xxhash

        seeds = hash_seeds()
        for batch in batches:
            for at, texts in text_slices(batch.column("text")):
                sizes, digests, sigs = [], [], []
                for values in shingle_sets(texts):
                    sizes.append(len(values))
                    digests.append(xxhash.xxh3_128_digest(values.tobytes()) if len(values) else None)
                    sigs.append(signature(values, seeds).tobytes() if len(values) else None)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(at, len(texts)),
                    batch.column("text_hash").slice(at, len(texts)), pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()),
                ], names=["doc_id", "text_hash", "n_shingles", "digest", "sig"])

    return with_text_hash(docs).mapInArrow(
        run, "doc_id long, text_hash long, n_shingles long, digest binary, sig binary")


def with_text_hash(docs):
    """``doc_id, text_hash, text``: the hash tells apart texts that share a doc_id."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.xxhash64("text").alias("text_hash"), "text")


def full_sets(docs):
    """``id, items``: the full shingle sets of ``id, text``, as binary."""
    def run(batches):
        for batch in batches:
            for at, texts in text_slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(at, len(texts)),
                    pa.array([v.tobytes() for v in shingle_sets(texts)], pa.binary()),
                ], names=["id", "items"])

    return docs.select("id", "text").mapInArrow(run, "id long, items binary")


def filed(classes):
    """Each class under the keys of its signature: ``key, id``."""
    def run(batches):
        import numpy as np

        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                part = batch.slice(at, 5000)
                sigs = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16)
                sigs = sigs.reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
                keys = np.empty((len(sigs), CHUNKS, WIDTH), dtype=np.uint64)
                for left_out in range(WIDTH):
                    key = np.arange(CHUNKS, dtype=np.uint64)[None] * np.uint64(WIDTH)
                    key = np.repeat(key + np.uint64(left_out), len(sigs), axis=0)
                    for k in range(WIDTH):
                        if k != left_out:
                            key = (key << np.uint64(16)) | sigs[:, :, k]
                    keys[:, :, left_out] = key
                per = CHUNKS * WIDTH
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys.reshape(-1).view(np.int64)),
                    part.column("id").take(pa.array(np.repeat(np.arange(len(sigs)), per))),
                ], names=["key", "id"])

    return classes.select("id", "sig").mapInArrow(run, "key long, id long")


def with_distance(pairs, classes):
    """Add the signature distance of pairs ``a, b`` and keep those within reach."""
    one = classes.select(F.col("id").alias("a"), F.col("sig").alias("sig_a"), F.col("n").alias("n_a"))
    two = classes.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"), F.col("n").alias("n_b"))
    part, whole = SIMILARITY
    both = pairs.join(one, "a").join(two, "b").filter(
        f"{whole} * least(n_a, n_b) >= {part} * greatest(n_a, n_b)")

    def run(batches):
        import numpy as np

        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16)
                        .reshape(-1, CHUNKS * WIDTH) for c in ("sig_a", "sig_b"))
                d = (a != b).sum(axis=1).astype(np.int32)
                near = pa.array(d <= DISTANCE)
                yield pa.RecordBatch.from_arrays([
                    batch.column("a").filter(near), batch.column("b").filter(near),
                    pa.array(d).filter(near)], names=["a", "b", "d"])

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long, d int")


def confirmed(pairs, sets):
    """Those of the pairs ``a, b`` whose full sets are similar enough."""
    part, whole = SIMILARITY
    joined = pairs.select("a", "b").join(
        sets.select(F.col("id").alias("a"), F.col("items").alias("of_a")), "a"
    ).join(sets.select(F.col("id").alias("b"), F.col("items").alias("of_b")), "b")

    def run(batches):
        import numpy as np

        for batch in batches:
            linked = []
            for x, y in zip(batch.column("of_a"), batch.column("of_b"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                small, large = (x, y) if len(x) < len(y) else (y, x)
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                shared = int((large[at] == small).sum()) if len(large) else 0
                linked.append(bool(small.size) and whole * shared >= part * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return joined.select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def components(edges):
    """``id, component``: the smallest id reachable, for every id on an edge."""
    ways = stored(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    labels = stored(ways.groupBy(F.col("a").alias("id")).agg(
        F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        reached = ways.join(labels.select(F.col("id").alias("b"), "component"), "b") \
            .select(F.col("a").alias("id"), "component")
        jumped = labels.join(
            labels.select(F.col("id").alias("component"), F.col("component").alias("next")),
            "component").select("id", F.col("next").alias("component"))
        new = stored(reached.unionByName(jumped).groupBy("id").agg(F.min("component").alias("component")))
        changed = new.join(labels.withColumnRenamed("component", "before"), "id") \
            .filter("component <> before").limit(1).count()
        labels = new
        if not changed:
            return labels


def labelled(table, labels, column="id", name="component"):
    """Add the component of a column's ids; an id without a link is its own."""
    known = labels.select(F.col("id").alias("_id"), F.col("component").alias("_component"))
    return table.join(known, F.col(column) == F.col("_id"), "left").withColumn(
        name, F.coalesce("_component", column)).drop("_id", "_component")


def in_blocks(open_keys):
    """Deal the members of a key to blocks, and each to its meetings with all blocks.

    ``key, id, component, block, low, high``: a group (key, low, high) is the meeting
    of two blocks, or of one with itself, so a key with very many members is spread
    over the tasks.
    """
    sizes = open_keys.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = open_keys.join(sizes, "key").withColumn(
        "block", F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int"))
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("key", "id", "component", "block",
                F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))


def reachable(table):
    """For each row of a group, those it must be compared with: of another component and within
    the distance and the sizes, and no earlier key is shared."""
    import numpy as np

    part, whole = SIMILARITY
    comp, block, n = (np.asarray(table.column(c)) for c in ("component", "block", "n"))
    key, low, high = (table.column(c)[0].as_py() for c in ("key", "low", "high"))
    chunk, left_out = divmod(key >> (16 * (WIDTH - 1)), WIDTH)
    sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(len(n), -1)
    two = np.flatnonzero(block == high)
    for i in np.flatnonzero(block == low).tolist():
        js = two[two > i] if low == high else two
        js = js[(comp[js] != comp[i])
                & (whole * np.minimum(n[js], n[i]) >= part * np.maximum(n[js], n[i]))]
        if not len(js):
            continue
        same = (sigs[js] == sigs[i]).reshape(len(js), CHUNKS, WIDTH)
        per_chunk = same.sum(axis=2)
        first = (per_chunk[:, :chunk] < WIDTH - 1).all(axis=1)
        if left_out:  # with all positions equal, the key that leaves out the first counts
            first &= ~same[:, chunk, left_out]
        js = js[first & (CHUNKS * WIDTH - per_chunk.sum(axis=1) <= DISTANCE)]
        if len(js):
            yield i, js


def to_compare(blocks, classes):
    """The rows of ``in_blocks`` that have anything to be compared with in their group."""
    names = ["key", "id", "component", "block", "low", "high"]

    def run(table):
        import numpy as np

        used = np.zeros(table.num_rows, bool)
        for i, js in reachable(table):
            used[i] = used[js] = True
        return table.select(names).filter(pa.array(used))

    return blocks.join(classes.select("id", "n", "sig"), "id").groupBy("key", "low", "high").applyInArrow(
        run, "key long, id long, component long, block int, low int, high int")


def crossing(compared, classes, sets):
    """Links between different components under one key: ``a, b``.

    All that are in reach of each other are compared on their full sets within their
    group; of the links found, those that join components are returned.
    """
    part, whole = SIMILARITY

    def run(table):
        import numpy as np

        ids, comp = (np.asarray(table.column(c)) for c in ("id", "component"))
        items = [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()]
        n = np.array([len(x) for x in items])
        # Shingles as numbers; one that a single member has is shared with nobody.
        _, number, times = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
        common = times[number] > 1
        owner = np.repeat(np.arange(len(ids)), n)[common]
        number = number[common]
        edges = np.searchsorted(owner, np.arange(len(ids) + 1))
        has = np.zeros(len(times), bool)
        root = {c: c for c in set(comp.tolist())}

        def find(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        links = []
        for i, js in reachable(table):
            mine = number[edges[i]:edges[i + 1]]
            has[mine] = True
            sums = np.concatenate([[0], np.cumsum(has[number])])
            has[mine] = False
            shared = sums[edges[js + 1]] - sums[edges[js]]
            for j in js[whole * shared >= part * (n[js] + n[i] - shared)]:
                x, y = find(int(comp[i])), find(int(comp[j]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    links.append((int(ids[i]), int(ids[j])))
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    full = classes.select("id", "n", "sig").join(sets, "id")
    return compared.join(full, "id").groupBy("key", "low", "high").applyInArrow(run, "a long, b long")


def near_duplicates(docs):
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``.

    Words are what ASCII white space separates, A-Z counting as a-z.  A text of fewer
    words is one shingle; null, empty and blank texts have none and are linked with
    nothing.  Documents are linked from a similarity of 0.75 of their sets up.
    ``component_id`` is the smallest doc_id reachable over links and ``kept`` tells
    whether it is the document's own; of different sets of one component that share this
    doc_id one is kept.  Rows that share a doc_id but not a text are judged each by its
    own; repeated rows stay repeated.  A null doc_id has no component and is kept.  An
    empty table gives no rows; other columns are not looked at.
    """
    return judged(docs).select("doc_id", "n_shingles", "component_id", "kept")


def judged(docs):
    """``near_duplicates`` with the ``text_hash`` and the set's ``digest`` of each row."""
    found = stored(described(docs))
    members = found.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    repeated = bool(members.groupBy("doc_id", "text_hash").count().filter("count > 1").limit(1).count())
    # Different sets may share their smallest doc_id, so classes get ids of their own; of
    # each the row (doc_id, text_hash) stands for its set.
    classes = stored(with_row_key(members.groupBy("digest").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("row"), F.first("n_shingles").alias("n"),
        F.min("sig").alias("sig")), "id"))
    keys = filed(classes)
    shared = keys.groupBy("key").agg(F.min("id").alias("centre"), F.max("id").alias("last")) \
        .filter("centre <> last").select("key", "centre")
    met = stored(keys.join(shared, "key"))

    # Each class against the nearest of the smallest classes of its keys.
    stars = met.filter("id <> centre").select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct()
    nearest = stored(with_distance(stars, classes).groupBy("a").agg(
        F.min_by("b", F.struct("d", "b")).alias("b")))
    labels = None
    if met.limit(1).count():
        wanted = nearest.select(F.col("a").alias("id")).union(nearest.select("b")).distinct()
        links = stored(confirmed(nearest, sets_of(docs, wanted, classes, repeated)))
        labels = components(links)
        seen = labelled(met.select("key", "id"), labels)
        mixed_keys = seen.groupBy("key").agg(
            F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("key")
        open_keys = stored(seen.join(mixed_keys, "key"))
        compared = stored(to_compare(in_blocks(open_keys), classes))
        sets = sets_of(docs, compared.select("id").distinct(), classes, repeated)
        more = stored(crossing(compared, classes, sets))
        if more.limit(1).count():
            labels = components(links.unionByName(more))
    # Components are named by the smallest doc_id in them, and its class comes first.
    of_class = classes.select("digest", "id", F.col("row.doc_id").alias("_least"))
    if labels is None:
        of_class = of_class.select("digest", F.col("_least").alias("component"), F.lit(True).alias("_first"))
    else:
        heads = labels.join(of_class.select("id", "_least", "digest"), "id").groupBy("component").agg(
            F.min(F.struct("_least", "digest", "id")).alias("head"))
        named = labels.join(heads, "component").select(
            F.col("id").alias("_id"), F.col("head._least").alias("_named"),
            (F.col("head.id") == F.col("id")).alias("_is_head"))
        of_class = of_class.join(named, F.col("id") == F.col("_id"), "left").select(
            "digest", F.coalesce("_named", "_least").alias("component"),
            F.coalesce("_is_head", F.lit(True)).alias("_first"))
    # Texts without a word have no class; all of them would meet in one task of the join.
    blank = found.filter("digest IS NULL").withColumns({
        "component": F.lit(None).cast("long"), "_first": F.lit(None).cast("boolean")})
    joined = found.filter("digest IS NOT NULL").join(of_class, "digest", "left").unionByName(blank)
    result = joined.withColumn(
        "component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
    return result.select(
        "doc_id", "text_hash", "digest", "n_shingles", "component_id",
        (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))
         & F.coalesce("_first", F.lit(True))).alias("kept"))


def sets_of(docs, wanted, classes, repeated):
    """Full sets of the classes whose ids are wanted, one each.

    ``repeated`` tells whether any row may stand there several times; only then are the
    wanted texts shuffled once more, to leave one of each.
    """
    rows = wanted.join(classes.select("id", "row.doc_id", "row.text_hash"), "id")
    texts = with_text_hash(docs).join(rows, ["doc_id", "text_hash"])
    return full_sets(texts.dropDuplicates(["id"]) if repeated else texts)
