"""Encoding and decoding of whole texts with a SentencePiece model of the merge type.

A merge model starts from single characters and, again and again, joins the two
neighbours whose piece has the best score, the leftmost of equal ones.  A sequence of
pieces is the encoding of its text exactly if every two neighbours are *compatible*: the
two, merged again from their characters, give the same two pieces.  (The first merge that
reached over the border between two pieces would do so in the two alone as well.)  So the
encoding is found without merging the text: from every place the longest piece is tried,
then ever shorter ones, and the first that is compatible with the piece before it is
taken.  Where none is, the place is marked in a bit field as failed and the last piece is
given up for a shorter one.  Every place fails at most once, so time is linear in the
text.  The longest pieces of all places come from one run of an Aho-Corasick automaton.

Characters that are no piece merge with nothing; each becomes the pieces of its bytes.
"""

from itertools import pairwise

import pyarrow as pa
from pyspark.sql import types as T

from plyclock.llm.common import free_name, text_slices

#: How the model writes a blank.
BLANK = "▁"
#: A mark between units of text; texts that hold it are encoded in one go.
CUT = "\x00"
#: Marks that may be cut off the word before them.
MARKS = ".,;:!?"
#: Strings on which a model shows whether it takes text as it is.
TRIED = ("a b", " a  b ", "ﬁ Å １　́e", "A\tb\r\nc", " ​­", BLANK, "\U0001f600")


def model_path(name="piece_bpe_32k.model"):
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """Encodes and decodes; remembers pairs of pieces and units of text, within bounds.

    ``units`` and ``pairs`` bound what is remembered; a full table is emptied.
    """

    def __init__(self, path, units=500_000, pairs=400_000):
        import ahocorasick
        import numpy as np
        import sentencepiece

        self.np = np
        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size())
               if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.pieces = {model.id_to_piece(i): i for i in ids}
        self.text = {i: p for p, i in self.pieces.items()}
        self.score = {p: model.get_score(i) for p, i in self.pieces.items()}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(model.is_byte(i) for i in self.bytes):
            raise ValueError("the model has no pieces for single bytes")
        self.length = {i: len(p) for p, i in self.pieces.items()}
        self.shorter = {i: next((self.pieces[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.pieces), None)
                        for p, i in self.pieces.items()}
        self.longest = ahocorasick.Automaton()
        for p, i in self.pieces.items():
            self.longest.add_word(p, (i, len(p)))
        self.longest.make_automaton()
        # No piece reaches over a cut, so what lies between cuts can be encoded apart.
        self.cut_blanks = not any(BLANK in p.lstrip(BLANK) for p in self.pieces)
        self.cut_lines = not any("\n" in p for p in self.pieces)
        self.cut_marks = "".join(m for m in MARKS if not any(
            b == m and a.isalpha() for p in self.pieces for a, b in pairwise(p)))
        self.plain = all(model.normalize(t) == BLANK + t.replace(" ", BLANK) for t in TRIED)
        self.most_units, self.most_pairs = units, pairs
        self.fitting, self.pairs, self.alone = {}, 0, {}
        self.forget()
        written = [b""] * model.get_piece_size()
        for p, i in self.pieces.items():
            written[i] = p.replace(BLANK, " ").encode()
        for b, i in enumerate(self.bytes):
            written[i] = bytes([b])
        self.written = pa.array(written, pa.large_binary())
        self.opens = np.array([w[:1] == b" " for w in written])
        self.is_text = np.array([len(w) > 0 for w in written])

    # Compatibility

    def merged(self, text):
        """Pieces of a short text by merging; a character that is no piece stays as it is."""
        parts = list(text)
        while True:
            best, at = None, None
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def is_alone(self, piece):
        """Whether the text of a piece is encoded as this piece."""
        if piece not in self.alone:
            self.alone[piece] = self.merged(self.text[piece]) == [self.text[piece]]
        return self.alone[piece]

    def fits(self, one, other):
        """Whether two neighbouring pieces, merged again, give the same two."""
        row = self.fitting.get(one)
        if row is None or other not in row:
            if self.pairs >= self.most_pairs:
                self.fitting, self.pairs = {}, 0
            a, b = self.text[one], self.text[other]
            row = self.fitting.setdefault(one, {})
            row[other] = self.merged(a + b) == [a, b]
            self.pairs += 1
        return row[other]

    # Encoding

    def encode_text(self, text, cut=None):
        """Ids of a text in the model's own writing, blanks as ``BLANK``.

        The character ``cut``, which must be no piece, is written as -1.
        """
        from array import array

        size = len(text)
        longest = array("i", [-1]) * size
        for end, (piece, length) in self.longest.iter(text):
            # Pieces from one start are met by growing end, so the longest comes last.
            longest[end - length + 1] = piece
        failed, any_failed = bytearray(size // 8 + 1), False
        length, shorter, fits, is_alone = self.length, self.shorter, self.fits, self.is_alone
        ids, last, first, at = [], None, 0, 0
        piece = longest[0] if size else None
        while at < size:
            if piece is not None and piece < 0:
                # No piece starts here, so none reaches over this character.
                ids += [-1] if text[at] == cut else [self.bytes[b] for b in text[at].encode()]
                last, first, at = None, len(ids), at + 1
                piece = longest[at] if at < size else None
                continue
            known = None if last is None else self.fitting.get(last)
            while piece is not None:
                after = at + length[piece]
                if not (any_failed and failed[after >> 3] >> (after & 7) & 1):
                    if last is None:
                        if is_alone(piece):
                            break
                    else:
                        good = None if known is None else known.get(piece)
                        if good or good is None and fits(last, piece):
                            break
                piece = shorter[piece]
            if piece is not None:
                ids.append(piece)
                last, at = piece, after
                if at < size:
                    piece = longest[at]
            else:
                if last is None:
                    raise AssertionError("no encoding from single characters")
                failed[at >> 3] |= 1 << (at & 7)
                any_failed = True
                piece = ids.pop()
                last = ids[-1] if len(ids) > first else None
                at -= length[piece]
        return ids

    def forget(self):
        np = self.np
        self.known, self.flat = {}, np.empty(0, np.int32)
        self.starts, self.sizes = np.empty(0, np.int64), np.empty(0, np.int64)

    def learn(self, units, together=2000):
        """Remember new units, so many of them in one run of the automaton."""
        np = self.np
        flat, sizes = [self.flat], []
        for i in range(0, len(units), together):
            ids = self.encode_text(CUT.join(units[i:i + together]), CUT)
            ids = np.fromiter(ids, np.int32, len(ids))
            marks = np.flatnonzero(ids == -1)
            flat.append(ids[ids != -1])
            sizes.append(np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1)
        self.known.update(zip(units, range(len(self.known), len(self.known) + len(units)), strict=True))
        self.flat, self.sizes = np.concatenate(flat), np.concatenate([self.sizes, *sizes])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def encode(self, texts):
        """Flat ids of an Arrow column of texts and the number of ids of each; null is empty."""
        import pyarrow.compute as pc

        np = self.np
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if self.plain:
            blanks = pc.replace_substring(texts, " ", BLANK)
            first, none = (pa.scalar(x, pa.large_string()) for x in (BLANK, ""))
            texts = pc.if_else(pc.equal(texts, none), none, pc.binary_join_element_wise(first, blanks, none))
        else:
            texts = pa.array([self.model.normalize(t) for t in texts.to_pylist()], pa.large_string())
        marked = texts
        if self.cut_blanks and pc.any(pc.match_substring(marked, 2 * BLANK)).as_py():
            marked = pc.replace_substring_regex(marked, f"([^{BLANK}]){BLANK}", rf"\1{CUT}{BLANK}")
        elif self.cut_blanks:
            marked = pc.replace_substring(marked, BLANK, CUT + BLANK)
        if self.cut_marks:
            marked = pc.replace_substring_regex(marked, rf"(\p{{L}})([{self.cut_marks}])", rf"\1{CUT}\2")
        if self.cut_lines:
            marked = pc.replace_substring(marked, "\n", f"{CUT}\n{CUT}")
        # A text with the mark in it is one unit.
        holds = pc.match_substring(texts, CUT)
        units = pc.split_pattern(pc.if_else(holds, pa.scalar("", pa.large_string()), marked), CUT)
        if isinstance(units, pa.ChunkedArray):
            units = units.combine_chunks()
        per_text = np.asarray(pc.list_value_length(units), np.int64)
        coded = pc.dictionary_encode(units.flatten())
        distinct = coded.dictionary.to_pylist()
        if len(self.known) + len(distinct) > self.most_units:
            self.forget()
        new = [u for u in distinct if u not in self.known]
        if new:
            self.learn(new)
        known = self.known
        unit = np.fromiter((known[u] for u in distinct), np.int64, len(distinct))[np.asarray(coded.indices)]
        sizes = self.sizes[unit]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[unit] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        flat = self.flat[at]
        counts = np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])])
        odd = np.flatnonzero(np.asarray(holds))
        if len(odd):
            parts = np.split(flat, np.cumsum(counts)[:-1])
            for i in odd:
                parts[i] = np.array(self.encode_text(texts[int(i)].as_py()), np.int32)
            flat, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return flat, counts

    # Decoding

    def decode(self, flat, counts):
        """The texts of runs of ids, as the library's ``decode`` writes them."""
        np = self.np
        words = self.written.take(pa.array(flat))
        at = np.frombuffer(words.buffers()[1], np.int64)[:len(flat) + 1]
        data = memoryview(words.buffers()[2]) if len(flat) else memoryview(b"")
        ends = np.cumsum(counts)
        starts = ends - counts
        out = []
        bad = np.concatenate([[0], np.cumsum(~self.is_text[flat])])
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if a == b:
                out.append("")
            elif bad[b] > bad[a] or not self.opens[flat[a]]:
                out.append(self.model.decode(flat[a:b].tolist()))
            else:
                try:
                    # The blank before the first word is the model's, not the text's.
                    out.append(str(data[at[a] + 1:at[b]], "utf-8"))
                except UnicodeDecodeError:
                    out.append(self.model.decode(flat[a:b].tolist()))
        return pa.array(out, pa.string())


def _list_column(flat, counts):
    import numpy as np

    ends = np.concatenate([[0], np.cumsum(counts)])
    if ends[-1] >= 1 << 31:
        raise ValueError("too many ids for one batch")
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def encode_documents(docs, path=None, text="text", ids="piece_ids", decoded=None, keep=None):
    """Add the ids of every whole text, ``array<int>``, without begin or end ids.

    ``decoded`` names a further column for the text that the ids decode to, made in the
    same pass.  ``keep`` names the columns to carry along (default: all).  Null and
    empty texts get an empty list; repeated rows stay repeated; an empty table stays
    empty; a text of any length is encoded whole, its words apart where no piece can
    reach over the blank between them.  A name that a kept column has already raises.
    """
    path = path or model_path()
    keep = list(docs.columns if keep is None else keep)
    new = [ids, *([decoded] if decoded else [])]
    for name in new:
        if free_name(docs.select(*keep), name) != name:
            raise ValueError(f"the table already has a column {name}")
    schema = T.StructType([*docs.select(*keep).schema, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    if decoded:
        schema = schema.add(decoded, T.StringType())
    kept_part = free_name(docs, "_text")

    def run(batches):
        encoder = None
        for batch in batches:
            encoder = encoder or PieceEncoder(path)
            for at, texts in text_slices(batch.column(kept_part), 2_000_000):
                flat, counts = encoder.encode(texts)
                part = batch.slice(at, len(texts)).select(keep)
                columns = [*part.columns, _list_column(flat, counts)]
                if decoded:
                    columns.append(encoder.decode(flat, counts))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *new])

    return docs.select(*keep, docs[text].alias(kept_part)).mapInArrow(run, schema)


def decode_documents(docs, path=None, ids="piece_ids", text="decoded_text"):
    """Add the text that the model makes of any ids; null ids give null.

    A name that the table has already raises.
    """
    import numpy as np

    path = path or model_path()
    if free_name(docs, text) != text:
        raise ValueError(f"the table already has a column {text}")
    names = docs.columns
    schema = T.StructType([*docs.schema]).add(text, T.StringType())

    def run(batches):
        encoder = None
        for batch in batches:
            encoder = encoder or PieceEncoder(path)
            column = batch.column(names.index(ids))
            counts = np.array([0 if c is None else c for c in pa.compute.list_value_length(column).to_pylist()], np.int64)
            made = encoder.decode(np.asarray(column.flatten(), np.int32), counts)
            made = pa.compute.if_else(column.is_null(), pa.scalar(None, pa.string()), made)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*names, text])

    return docs.mapInArrow(run, schema)
