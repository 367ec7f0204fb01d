"""Encoding and decoding of whole texts with a public BPE tokenizer.

Encoding by the tokenizers library costs the same for the hundredth copy of a word
as for the first.  Texts are therefore cut at ASCII white space, which the
tokenizer drops and never merges across, each distinct word of a batch is encoded
once by the library, and the ids are put together again by position.

Text that offers no such cut is encoded by *tree concatenation*: halves are encoded
apart, then a window around the join is encoded again and grown until it shares a
pair of neighbouring tokens with the left half and a pair with the right half.  In
BPE a sequence of tokens is the encoding exactly if every neighbouring pair is, so
the left half up to its shared pair, the window between, and the right half from
its own are together the encoding of the whole.
"""

import functools

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plyclock.llm.common import free_name, give_back, stored, text_slices, with_row_key

#: A mark between words joined for one call; words that hold it are encoded alone.
MARK = "\x01"
#: Unsplit runs above so many characters are encoded by halves.
LEAF_CHARS = 4096
#: Texts above so many characters are cut into pieces that are encoded by other tasks.
PIECE_CHARS = 1 << 17
#: No token pair this close to a cut counts as agreed: a special token or a
#: contraction may reach over it.
MARGIN = 16


def tokenizer_path(name="word_bpe_49k.json"):
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def leaf_encoding(tokenizer, text, shift=0):
    """Ids with the span of each, as three arrays."""
    import numpy as np

    done = tokenizer.encode(text, add_special_tokens=False)
    spans = np.array(done.offsets, dtype=np.int64).reshape(-1, 2) + shift
    return np.array(done.ids, dtype=np.uint32), spans[:, 0], spans[:, 1]


def shared_pairs(one, other):
    """Positions (i, j) with tokens i, i+1 of ``one`` equal to j, j+1 of ``other``."""
    import numpy as np

    (a, a0, a1), (b, b0, b1) = one, other
    if not len(a) or not len(b):
        return np.empty((0, 2), dtype=np.int64)
    # Tokens of one encoding can share a span, so a run of equal spans has no order.
    at = np.searchsorted(b0, a0)
    at[at == len(b)] = len(b) - 1
    same = (b[at] == a) & (b0[at] == a0) & (b1[at] == a1)
    i = np.flatnonzero(same[:-1] & same[1:] & (at[1:] == at[:-1] + 1))
    return np.stack([i, at[i]], axis=1)


def joined(tokenizer, text, left, right, cut, window=64):
    """The encoding of ``text`` from those of ``text[:cut]`` and ``text[cut:]``.

    Spans of all three count from the start of ``text``.  The window doubles until
    both sides agree; at worst it covers the whole text.
    """
    import numpy as np

    size = len(text)
    while True:
        p, q = max(0, cut - window), min(size, cut + window)
        if p == 0 and q == size:
            return leaf_encoding(tokenizer, text)
        middle = leaf_encoding(tokenizer, text[p:q], p)
        near = np.searchsorted(left[1], p)
        tail = tuple(x[near:] for x in left)
        upto = np.searchsorted(right[1], q, side="right")
        head = tuple(x[:upto] for x in right)
        a = b = None
        if p == 0:
            a = (0, 0)
        else:
            pairs = shared_pairs(tail, middle)
            pairs = pairs[tail[2][pairs[:, 0] + 1] <= cut - MARGIN]
            if len(pairs):
                a = (near + pairs[-1][0] + 1, pairs[-1][1] + 1)
        if q == size:
            b = (len(right[0]), len(middle[0]))
        else:
            pairs = shared_pairs(head, middle)
            pairs = pairs[(head[1][pairs[:, 0]] >= cut + MARGIN)
                          & (head[2][pairs[:, 0] + 1] <= q - MARGIN)]
            if len(pairs):
                b = (pairs[0][0] + 1, pairs[0][1] + 1)
        if a and b and a[1] <= b[1]:
            return tuple(np.concatenate([x[:a[0]], y[a[1]:b[1]], z[b[0]:]])
                         for x, y, z in zip(left, middle, right, strict=True))
        window *= 2


def joined_all(tokenizer, pieces, texts):
    """Join neighbouring pieces level by level until one encoding is left."""
    shifted = []
    for ids, starts, ends in pieces:
        shifted.append((ids, starts, ends))
    while len(shifted) > 1:
        parts, joins = [], []
        for i in range(0, len(shifted), 2):
            if i + 1 == len(shifted):
                parts.append(shifted[i])
                joins.append(texts[i])
                continue
            cut, text = len(texts[i]), texts[i] + texts[i + 1]
            ids, starts, ends = shifted[i + 1]
            parts.append(joined(tokenizer, text, shifted[i], (ids, starts + cut, ends + cut), cut))
            joins.append(text)
        shifted, texts = parts, joins
    return shifted[0]


def tree_encoding(tokenizer, text, leaf=LEAF_CHARS):
    """Encode an unsplit text by halves; equal to encoding it at once."""
    if len(text) <= leaf:
        return leaf_encoding(tokenizer, text)
    pieces = [text[i:i + leaf] for i in range(0, len(text), leaf)]
    return joined_all(tokenizer, [leaf_encoding(tokenizer, p) for p in pieces], pieces)


class PlainWords:
    """A short way for words of Latin letters, with or without ordinary punctuation.

    A tokenizer that lower-cases, cuts between letters and punctuation and then works
    on bytes spends most of its time on finding the cuts.  For these words they are
    known, so the library gets the parts ready made.  Whether the tokenizer is of this
    kind is tried on a few words when it is loaded; if not, the short way is off.
    """

    #: Latin letters whose lower case is a single letter.
    SHAPE = "([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([.,;:!?]*)"
    TRIED = ("the", "Then,", "EREDES!!", "\u00c9l\u00e8ve", "na\u00efve?!", "\u00d1o\u00f1o.", "\u0178\u0131\u01c5", "a", "qu.:;")

    def __init__(self, path):
        import re

        import numpy as np
        from tokenizers import normalizers, pre_tokenizers

        self.shape = re.compile(self.SHAPE).fullmatch
        self.tokenizer = load_tokenizer(path)
        self.tokenizer.normalizer = normalizers.Sequence([])
        self.tokenizer.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        # Bytes are written as letters; the printable ones stand for themselves.
        same = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(same)]
        self.letters = {b: chr(256 + i) for i, b in enumerate(rest)}
        full = load_tokenizer(path)
        self.works = all(
            self.tokenizer.encode(self.parts(w), add_special_tokens=False).ids
            == full.encode(w, add_special_tokens=False).ids for w in self.TRIED)

        # Bytes above ASCII and the mark by the letter that stands for each, all others as they are.
        self.table = np.array([ord(self.letters[b]) if b > 0x7F and b in self.letters else b
                               for b in range(256)], dtype="<u2")
        self.table[ord(MARK)] = ord(self.letters[ord(MARK)])

    def fits(self, words):
        """Which words of an Arrow column are of this kind."""
        import pyarrow.compute as pc

        return pc.match_substring_regex(words, f"^{self.SHAPE}$")

    def joined(self, words):
        """Words of this kind as the library takes them, in lists of 500 with marks between."""
        import numpy as np
        import pyarrow.compute as pc

        ready = pc.replace_substring_regex(
            pc.utf8_lower(words), r"^([^.,;:!?]+)([.,;:!?]+)$", r"\1 \2").to_pylist()
        for i in range(0, len(ready), 500):
            text = f" {MARK} ".join(ready[i:i + 500])
            yield self.table[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-16-le")

    def parts(self, word):
        """The word as parts between blanks, or None for a word of another kind."""
        found = self.shape(word)
        if not found:
            return None
        letters, marks = found.groups()
        letters = letters.lower()
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(self.letters)
        return f"{letters} {marks}" if marks else letters


#: Encoders that a worker process keeps between its tasks.
KEPT = "_corpus_encoders"


def kept_encoder(path):
    """The encoder of this process for a tokenizer file."""
    import sys
    import types

    kept = sys.modules.setdefault(KEPT, types.ModuleType(KEPT)).__dict__
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


def forget_encoders():
    """Let go of the encoders of this process, for operators that have no use for them."""
    import sys

    kept = sys.modules.get(KEPT)
    paths = [name for name in vars(kept) if not name.startswith("__")] if kept else []
    for path in paths:
        delattr(kept, path)
    if paths:
        give_back()


class WordEncoder:
    """Encodes columns of texts, each distinct word once while it is remembered.

    ``words`` bounds what is remembered, and so the memory; a full table is emptied.
    The words stand in an Arrow column, some tens of bytes each; a table of Python
    strings takes ten times as much.
    """

    def __init__(self, path, words=900_000, leaf=LEAF_CHARS):
        import os

        import numpy as np

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.words, self.leaf = load_tokenizer(path), words, leaf
        self.plain = PlainWords(path)
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        if len(self.mark) != 1:
            raise ValueError("the tokenizer has no single token for the mark")
        self.np = np
        self.forget()

    def forget(self):
        np = self.np
        self.known = pa.array([""], pa.large_string())
        self.ids = np.empty(0, dtype=np.uint32)
        self.starts, self.sizes = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def learn(self, words):
        """Remember new words; returns the place of each."""
        import pyarrow.compute as pc

        np = self.np
        if self.plain.works:
            fits = pc.and_(self.plain.fits(words), pc.less_equal(pc.utf8_length(words), self.leaf))
        else:
            fits = pa.array(np.zeros(len(words), bool))
        plain, rest = words.filter(fits), words.filter(pc.invert(fits))
        is_odd = pc.or_(pc.greater(pc.utf8_length(rest), self.leaf), pc.match_substring(rest, MARK))
        usual, odd = rest.filter(pc.invert(is_odd)), rest.filter(is_odd)
        ids, sizes = [self.ids], [self.sizes]
        sign = self.plain.tokenizer.token_to_id(self.tokenizer.id_to_token(self.mark[0]))
        listed = usual.to_pylist()
        for tokenizer, mark, count, todo in (
            (self.plain.tokenizer, sign, len(plain), self.plain.joined(plain)),
            (self.tokenizer, self.mark[0], len(usual),
             (f" {MARK} ".join(listed[i:i + 500]) for i in range(0, len(listed), 500))),
        ):
            for i, text in enumerate(todo):
                # The fast call keeps no spans; there is one text, as a task has one core.
                got = np.array(
                    tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
                marks = np.flatnonzero(got == mark)
                if len(marks) != min(500, count - 500 * i) - 1:
                    raise AssertionError("words and marks do not match")
                ids.append(got[got != mark])
                sizes.append(np.diff(np.concatenate([[-1], marks, [len(got)]])) - 1)
        for w in odd.to_pylist():
            got = tree_encoding(self.tokenizer, w, self.leaf)[0]
            ids.append(got)
            sizes.append(np.array([len(got)]))
        # Plain words come first, then the usual, then the odd ones.
        kind = np.zeros(len(words), np.int8)
        kind[~np.asarray(fits)] = 1 + np.asarray(is_odd)
        places = np.empty(len(words), np.int64)
        places[np.argsort(kind, kind="stable")] = len(self.known) + np.arange(len(words))
        self.known = pa.concat_arrays([self.known, plain, usual, odd])
        self.ids, self.sizes = np.concatenate(ids), np.concatenate(sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        return places

    def encode(self, texts):
        """Flat ids of all texts and the number of ids of each; null counts as empty."""
        import pyarrow.compute as pc

        np = self.np
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        if isinstance(split, pa.ChunkedArray):
            split = split.combine_chunks()
        per_text = np.asarray(pc.list_value_length(split), dtype=np.int64)
        coded = pc.dictionary_encode(split.flatten())
        distinct = coded.dictionary.cast(pa.large_string())
        if len(self.known) + len(distinct) > self.words:
            self.forget()
        found = pc.index_in(distinct, value_set=self.known)
        new = np.asarray(pc.is_null(found))
        place = np.asarray(pc.fill_null(found, 0), dtype=np.int64).copy()
        if new.any():
            place[new] = self.learn(distinct.filter(pa.array(new)))
        word = place[np.asarray(coded.indices)]
        sizes = self.sizes[word]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.starts[word] - (ends - sizes), sizes)
        at += np.arange(total)
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]
        return self.ids[at], np.diff(edges)


def binary_column(flat, sizes):
    """Cut flat ids into one binary value per text, without a copy."""
    import numpy as np

    ends = np.concatenate([[0], np.cumsum(sizes)]) * flat.itemsize
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(sizes),
        [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())


def _encode_batches(path, text, ids, keep, decoded):
    def run(batches):
        encoder = kept_encoder(path)
        decoder = Decoder(path, encoder.tokenizer) if decoded else None
        for batch in batches:
            for at, texts in text_slices(batch.column(text)):
                flat, sizes = encoder.encode(texts)
                part = batch.slice(at, len(texts)).select(keep)
                coded = binary_column(flat, sizes)
                columns, names = [*part.columns, coded], [*keep, ids]
                if decoded:
                    columns.append(decoder.decode(coded))
                    names.append(decoded)
                yield pa.RecordBatch.from_arrays(columns, names=names)
    return run


def _encode_pieces(path, text, keep):
    def run(batches):
        tokenizer = load_tokenizer(path)
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                parts = tree_encoding(tokenizer, one.column(text)[0].as_py())
                yield pa.RecordBatch.from_arrays(
                    [*one.select(keep).columns,
                     *[pa.array([x.tobytes()], pa.binary()) for x in parts]],
                    names=[*keep, "_ids", "_starts", "_ends"])
    return run


def _join_pieces(path, key, number, text, ids):
    def run(table):
        import numpy as np

        tokenizer = load_tokenizer(path)
        order = np.argsort(np.asarray(table.column(number)))
        rows = table.take(pa.array(order)).to_pylist()
        pieces = [(np.frombuffer(r["_ids"], np.uint32), np.frombuffer(r["_starts"], np.int64),
                   np.frombuffer(r["_ends"], np.int64)) for r in rows]
        got = joined_all(tokenizer, pieces, [r[text] for r in rows])[0]
        return pa.table({key: pa.array([rows[0][key]], pa.int64()),
                         ids: pa.array([got.tobytes()], pa.binary())})
    return run


def encode_documents(docs, path=None, text="text", ids="token_ids", keep=None,
                     piece_chars=PIECE_CHARS, decoded=None):
    """Add the ids of every whole text as little-endian unsigned 32-bit integers.

    ``keep`` names the columns to carry along (default: all).  ``decoded`` names a further
    column for the text that the ids decode to, made in the same pass, with the same
    tokenizer.  A name that a kept column has already raises.  Null and empty texts
    get no ids; repeated rows stay repeated; an empty table stays empty; columns of
    other names are not looked at.  Texts above ``piece_chars`` are halved into
    pieces that other tasks encode, and joined again; each is then one group, no
    larger than its text.
    """
    path = path or tokenizer_path()
    keep = list(docs.columns if keep is None else keep)
    for name in [ids, *([decoded] if decoded else [])]:
        if name.lower() in {c.lower() for c in keep}:
            raise ValueError(f"the table already has a column {name}")
    columns = list(dict.fromkeys([*keep, text]))
    docs = docs.select(*columns)
    schema = T.StructType([*docs.select(*keep).schema, T.StructField(ids, T.BinaryType())])
    if decoded:
        schema = schema.add(decoded, T.StringType())
    is_long = F.coalesce(F.length(text), F.lit(0)) > piece_chars
    short = docs.filter(~is_long).mapInArrow(_encode_batches(path, text, ids, keep, decoded), schema)

    key, number, piece = (free_name(docs, c) for c in ("_row", "_piece", "_text"))
    # Written once: a key made anew for each use could differ between them.
    long = stored(with_row_key(docs.filter(is_long), key))
    cut = long.select(
        key, F.posexplode(F.transform(
            F.sequence(F.lit(0), F.floor((F.length(text) - 1) / piece_chars).cast("int")),
            lambda i: F.substring(F.col(text), i * piece_chars + 1, F.lit(piece_chars)),
        )).alias(number, piece),
    ).repartition(F.col(key), F.col(number))
    coded = cut.mapInArrow(
        _encode_pieces(path, piece, [key, number, piece]),
        f"`{key}` long, `{number}` int, `{piece}` string, _ids binary, _starts binary, _ends binary")
    whole = coded.groupBy(key).applyInArrow(
        _join_pieces(path, key, number, piece, ids), f"`{key}` long, `{ids}` binary")
    long = long.select(key, *keep).join(whole, key).select(*keep, ids)
    return short.unionByName(decode_documents(long, path, ids, decoded) if decoded else long)


def decode_documents(docs, path=None, ids="token_ids", text="decoded_text"):
    """Add the text that the tokenizer makes of the ids; null ids give null.

    A name that the table has already raises.
    """
    path = path or tokenizer_path()
    if free_name(docs, text) != text:
        raise ValueError(f"the table already has a column {text}")
    keep = docs.columns
    schema = T.StructType([*docs.schema, T.StructField(text, T.StringType())])

    def run(batches):
        decoder = None
        for batch in batches:
            decoder = decoder or Decoder(path)
            for at, part in text_slices(batch.column(ids), 16_000_000):
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(at, len(part)).columns, decoder.decode(part)],
                    names=[*keep, text])

    return docs.mapInArrow(run, schema)


class Decoder:
    """Writes ids as text by a table of the vocabulary.

    A tokenizer without a decoder joins its tokens with a blank; any other is asked
    itself, text by text.
    """

    def __init__(self, path, tokenizer=None):
        self.tokenizer = tokenizer or load_tokenizer(path)
        self.plain = self.tokenizer.decoder is None
        size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        words = [self.tokenizer.id_to_token(i) for i in range(size)]
        self.words = pa.array(["" if w is None else w + " " for w in words], pa.large_string())
        self.gaps = any(w is None for w in words)

    def decode(self, column):
        import numpy as np

        if not self.plain or self.gaps or column.null_count:
            return pa.array([
                None if x is None else self.tokenizer.decode(
                    np.frombuffer(x, np.uint32).tolist(), skip_special_tokens=False)
                for x in column.to_pylist()], pa.string())
        column = column.cast(pa.large_binary())
        edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset:][:len(column) + 1]
        flat = np.frombuffer(column.buffers()[2] or b"", np.uint8)[edges[0]:edges[-1]].view(np.uint32)
        words = self.words.take(pa.array(flat))
        at = np.frombuffer(words.buffers()[1], np.int64)[:len(flat) + 1]
        data = memoryview(words.buffers()[2]) if len(flat) else memoryview(b"")
        ends = at[(edges - edges[0]) // 4]
        return pa.array([bytes(data[a:max(a, b - 1)]) for a, b in zip(ends[:-1], ends[1:], strict=True)],
                        pa.binary()).cast(pa.string())
