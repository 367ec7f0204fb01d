"""Information-theoretic sanitisation of personal data.

*Protected entities* are e-mail addresses, IP addresses, payment cards and phone
numbers, found by fixed patterns.  A *term*, a run of letters and digits in lower case
outside of every entity, can reveal an entity of its document, however far from it.  How strongly
is estimated from the corpus: with N documents, n(e) of them holding an entity of kind
e, n(t) holding the term and n(e, t) holding both,

    PMI(e; t) = log2( P(e | t) N / n(e) ),    IC(e) = log2( N / n(e) )

where P(e | t) is not n(e, t) / n(t) itself but its lower confidence bound (Wilson's,
``CONFIDENCE`` standard deviations), so that a term of few documents counts as far as
those few can tell; no number of documents is asked for.  A term that carries
``DISCLOSURE`` of the information of a kind or more is generalised wherever it stands
in a document with entities, of whatever kind, and removed from ``REMOVAL`` on.
Documents without an entity are left as they are.

Entities are replaced by the name of their kind in brackets, generalised terms by their
class: ``CODE`` with a digit in it, ``NAME`` with a capital first, ``TERM`` otherwise.
"""

import math
import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plyclock.llm.common import free_name, stored, text_slices, with_row_key

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
CONFIDENCE = 1.96
DISCLOSURE, REMOVAL = 0.5, 0.9
#: Bits a term, and bits at most, of the filter that tells which words need counting.
FILTER_BITS, MOST_BITS = 16, 1 << 24
#: Terms whose counts a task holds before it hands them on.
HELD_TERMS = 400_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails from its start fails from every place in it.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
# A card needs 16 digits, so shorter runs need not be looked at.
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){15,}+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
WORD, LETTERS = re.compile(r"[^\W_]+"), re.compile(r"[^\W\d_]+")

SPAN = "struct<kind:string,start:int,end:int>"
MARKED = "array<struct<kind:string,start:int,end:int,disclosure:double>>"


def emails(text):
    """Addresses, leftmost first, in time linear in the text."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def entities(text):
    """``(kind, start, end)`` by kind, then place; ends exclusive, in code points."""
    found = []
    if not text:
        return found
    if "@" in text:
        found += [("email", a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m[0].split("."))):
                found.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= len(DIGIT.findall(m[0])) <= 15:
                    found.append(("phone", m.start(), m.end()))
    return found


def outside(text, spans):
    """The text with blanks for the spans and for all letters that reach into one."""
    out, free = [], 0
    for start, end in sorted(spans):
        start, end = max(start, free), max(end, free)
        if start < end:
            while start > free and LETTERS.fullmatch(text[start - 1:start + 1]):
                start -= 1
            while end < len(text) and LETTERS.fullmatch(text[end - 1:end + 1]):
                end += 1
            out += [text[free:start], " " * (end - start)]
            free = end
    return "".join([*out, text[free:]])


def with_entities(docs, spans, text="text", found_only=None):
    """Add the spans; optionally only rows with, or without."""
    schema = T.StructType([*docs.schema]).add(spans, T.DataType.fromDDL(f"array<{SPAN}>"))
    keep = docs.columns
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            for at, texts in text_slices(batch.column(text)):
                rows, some = [], []
                for i, value in enumerate(texts.to_pylist()):
                    found = entities(value)
                    if found_only is None or bool(found) == found_only:
                        rows.append(at + i)
                        some.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in found])
                yield pa.RecordBatch.from_arrays(
                    [*batch.take(pa.array(rows, pa.int64())).columns, pa.array(some, kinds)],
                    names=[*keep, spans])

    return docs.mapInArrow(run, schema)


def place_in_filter(term, bits):
    import xxhash

    return xxhash.xxh3_64_intdigest(term) % bits


def term_filter(terms):
    """A bit map of ``terms`` (one column), sized by their number up to ``MOST_BITS`` and
    broadcast: what it lets through by chance falls out in a join."""
    import numpy as np

    bits = min(MOST_BITS, 1 << max(12, (FILTER_BITS * terms.count()).bit_length()))

    def places(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({
                "place": pa.array([place_in_filter(t, bits) for t in batch.column("term").to_pylist()], pa.int64())})

    # One row per 64 places, so no more than MOST_BITS / 64 of them.
    held = terms.select("term").mapInArrow(places, "place long").groupBy(
        F.floor(F.col("place") / 64).alias("at")).agg(
        F.expr("bit_or(shiftleft(1L, int(place % 64)))").alias("bits")).collect()
    bitmap = np.zeros(bits // 64, np.int64)
    for r in held:
        bitmap[r["at"]] = r["bits"]
    return terms.sparkSession.sparkContext.broadcast(bitmap)


class Terms:
    """The distinct terms of texts; what one chunk of text has stays known for the next."""

    def __init__(self, wanted=None, remembered=400_000):
        self.wanted, self.remembered, self.known = wanted, remembered, {}

    def of_chunk(self, chunk):
        found = [w.lower() for w in WORD.findall(chunk)]
        if self.wanted is not None and found:
            bits = 64 * len(self.wanted)
            places = [place_in_filter(w, bits) for w in found]
            found = [w for w, x in zip(found, places, strict=True) if (int(self.wanted[x >> 6]) >> (x & 63)) & 1]
        return tuple(found)

    def by_row(self, texts):
        """``(rows, codes, terms)``: each distinct pair of a row and a term once, by row."""
        import numpy as np
        import pyarrow.compute as pc

        split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        per_text = np.asarray(pc.list_value_length(split), dtype=np.int64)
        coded = pc.dictionary_encode(split.flatten())
        chunks = coded.dictionary.to_pylist()
        if len(self.known) + len(chunks) > self.remembered:
            self.known = {}
        number, flat, sizes = {}, [], np.zeros(len(chunks), np.int64)
        for i, c in enumerate(chunks):
            if c not in self.known:
                self.known[c] = self.of_chunk(c)
            if found := self.known[c]:
                sizes[i] = len(found)
                flat += [number.setdefault(w, len(number)) for w in found]
        first = np.cumsum(sizes) - sizes
        codes = np.asarray(coded.indices)
        row = np.repeat(np.arange(len(per_text)), per_text)
        use = sizes[codes] > 0
        codes, row = codes[use], row[use]
        n = sizes[codes]
        at = np.repeat(first[codes] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pairs = np.unique(np.repeat(row, n) * max(1, len(number)) + np.array(flat, np.int64)[at])
        return *np.divmod(pairs, max(1, len(number))), list(number)


def spans_of(found):
    return [(s["start"], s["end"]) for s in found]


def private_counts(private, spans, text="text"):
    """``term, n, n_email, ...``: in how many rows each term stands outside of the entities,
    and in how many of those with an entity of each kind."""
    names = ["n", *["n_" + k for k in KINDS]]

    def run(batches):
        import numpy as np

        seen = Terms()
        for batch in batches:
            for at, texts in text_slices(batch.column(text)):
                found = batch.column(spans).slice(at, len(texts)).to_pylist()
                row, code, terms = seen.by_row(pa.array(
                    [outside(t, spans_of(f)) for t, f in zip(texts.to_pylist(), found, strict=True)], pa.string()))
                has = np.array([[True, *[any(s["kind"] == k for s in f) for k in KINDS]] for f in found])
                counts = [np.bincount(code[has[row, i]], minlength=len(terms)) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(terms, pa.string()), *[pa.array(c.astype(np.int64)) for c in counts]],
                    names=["term", *names])

    return private.select(text, spans).mapInArrow(
        run, "term string, " + ", ".join(f"{n} long" for n in names)) \
        .groupBy("term").agg(*[F.sum(n).alias(n) for n in names])


def clean_counts(docs, terms, text="text"):
    """``term, n_clean``: in how many rows without an entity each of ``terms`` (one column,
    distinct) occurs, and perhaps some other terms.

    A task adds up what it finds before it hands it on.
    """
    sent = term_filter(terms)

    def run(batches):
        import numpy as np

        def handed_on(counts):
            return pa.RecordBatch.from_pydict({
                "term": pa.array(list(counts), pa.string()), "n_clean": pa.array(list(counts.values()), pa.int64())})

        seen, counts = Terms(sent.value), {}
        for batch in batches:
            for _, texts in text_slices(batch.column(text)):
                clean = [not entities(t) for t in texts.to_pylist()]
                _, code, found = seen.by_row(texts.filter(pa.array(clean, pa.bool_())))
                for term, n in zip(found, np.bincount(code, minlength=len(found)).tolist(), strict=True):
                    counts[term] = counts.get(term, 0) + n
                if len(counts) > HELD_TERMS:
                    yield handed_on(counts)
                    counts = {}
        yield handed_on(counts)

    return docs.select(text).mapInArrow(run, "term string, n_clean long") \
        .groupBy("term").agg(F.sum("n_clean").alias("n_clean"))


def surely(n_both, n):
    """Wilson's lower bound of the share of ``n_both`` in ``n``; it falls as ``n`` grows."""
    z = CONFIDENCE
    return (n_both + z * z / 2 - z * F.sqrt(n_both * (n - n_both) / n + z * z / 4)) / (n + z * z)


def disclosing_terms(docs, private, spans, text="text"):
    """``term, disclosure``: terms that reveal an entity, with the largest share of any kind.

    ``private`` are the rows with entities, in ``spans``.
    """
    total = docs.count()
    near = stored(private_counts(private, spans, text))
    kinds = {r.kind: r.n for r in private.select(
        F.explode(F.array_distinct(F.transform(spans, lambda s: s["kind"]))).alias("kind")
    ).groupBy("kind").agg(F.count("*").alias("n")).collect()}

    def disclosure(n):
        # An entity in every document carries no information, so nothing reveals it.
        return F.greatest(F.lit(0.0), F.lit(0.0), *[
            F.when(F.col("n_" + k) > 0, F.log2(surely(F.col("n_" + k), n) * (total / of)) / math.log2(total / of))
            for k, of in kinds.items() if of < total])

    # With the rows of ``private`` alone the share is at its largest.
    likely = stored(near.withColumn("disclosure", disclosure(F.col("n"))).filter(
        F.col("disclosure") >= DISCLOSURE).drop("disclosure"))
    counts = clean_counts(docs, likely.select("term"), text)
    return likely.join(counts, "term", "left").select(
        "term", disclosure(F.col("n") + F.coalesce("n_clean", F.lit(0))).alias("disclosure")) \
        .filter(F.col("disclosure") >= DISCLOSURE)


def terms_by_row(private, terms, spans, text="text"):
    """``_of, _added``: the disclosing terms of each row, by ``_row``, with their disclosure."""
    sent = term_filter(terms)

    def run(batches):
        seen = Terms(sent.value)
        for batch in batches:
            for at, texts in text_slices(batch.column(text)):
                found = batch.column(spans).slice(at, len(texts)).to_pylist()
                row, code, held = seen.by_row(pa.array(
                    [outside(t, spans_of(f)) for t, f in zip(texts.to_pylist(), found, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_row").slice(at, len(texts)).take(pa.array(row)),
                     pa.array(held, pa.string()).take(pa.array(code))], names=["_of", "term"])

    # No more entries than distinct terms of one document.
    return private.select("_row", text, spans).mapInArrow(run, "_of long, term string").join(terms, "term") \
        .groupBy("_of").agg(F.collect_list(F.struct("term", "disclosure")).alias("_added"))


def sanitise(docs, text="text", spans="spans"):
    """Two tables with the columns of ``docs`` and ``spans``, apart in what they hold.

    ``(private, clean)``: rows with entities, their text masked and their spans in
    the original text (base kinds first, then terms with their disclosure), and the rows without, as
    they were, with an empty list.  A null text has no spans and stays null.  Repeated
    rows are treated alike and stay repeated; an empty table gives empty tables.
    """
    found = free_name(docs, "_found")
    if "_row" in docs.columns:
        raise ValueError("the column name _row is taken")
    private = stored(with_row_key(with_entities(docs, found, text, found_only=True), "_row"))
    terms = stored(disclosing_terms(docs, private, found, text))
    added = terms_by_row(private, terms, found, text)
    whole = private.join(added, F.col("_row") == F.col("_of"), "left").select(*docs.columns, found, "_added")
    clean = with_entities(docs, found, text, found_only=False).select(
        *docs.columns, F.array().cast(MARKED).alias(spans))
    return masked(whole, text, found, "_added", spans), clean


def masked(docs, text, found, added, spans):
    """Replace the entities in ``found`` and every occurrence of the terms in ``added``."""
    keep = [c for c in docs.columns if c not in (found, added)]
    at = keep.index(text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                               ("disclosure", pa.float64())]))

    def run(batches):
        for batch in batches:
            for start, texts in text_slices(batch.column(text)):
                part = batch.slice(start, len(texts))
                new, marks = [], []
                for t, entity, terms in zip(texts.to_pylist(), part.column(found).to_pylist(),
                                            part.column(added).to_pylist(), strict=True):
                    every = [s | {"disclosure": None} for s in entity]
                    if terms:
                        share = {x["term"]: x["disclosure"] for x in terms}
                        every += [{"kind": TERM, "start": m.start(), "end": m.end(), "disclosure": share[w]}
                                  for m in WORD.finditer(outside(t, spans_of(entity)))
                                  if (w := m[0].lower()) in share]
                    new.append(hide(t, every))
                    marks.append(every)
                columns = part.select(keep).columns
                columns[at] = pa.array(new, columns[at].type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(marks, kind)], names=[*keep, spans])

    schema = T.StructType([docs.schema[c] for c in keep]).add(spans, T.DataType.fromDDL(MARKED))
    return docs.mapInArrow(run, schema)


def class_of(term):
    """What a term is generalised to."""
    return "CODE" if DIGIT.search(term) else "NAME" if term[:1].isupper() else "TERM"


def hide(text, spans):
    """Spans that overlap are replaced together, by the name of the first."""
    out, free, last = [], 0, -1
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= last:
            out.append(text[free:s["start"]])
            if s["kind"] != TERM or s["disclosure"] < REMOVAL:
                out.append(f"[{s['kind'].upper() if s['kind'] != TERM else class_of(text[s['start']:s['end']])}]")
        last = free = max(last, s["end"])
    return "".join([*out, text[free:]])
