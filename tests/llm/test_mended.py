"""What was mended: counts of terms by task, classes of terms, encoding and decoding in one pass."""

import hashlib
import math
import random
from collections import Counter

import pytest

from plyclock.llm import privacy, queries, tokens
from test_words import SCHEMA, docs, empty, rows, table  # noqa: F401


def private_rows():
    rng = random.Random(2)
    names = ["Zorba", "x9k2m", "quiet", "river"]
    made = []
    for i in range(300):
        words = [rng.choice("the of and to in it is on at by".split()) for _ in range(30)]
        if i % 20 == 0:
            words += ["mail", f"who{i}@home.org", *names[:3]]
        words += ["river"] if i % 3 == 0 else []
        made.append((i, " ".join(words)))
    return [*made, made[0], (None, None), (400, "")]


def plain_disclosure(rows):
    """Term to its largest share over the kinds, by the formulas of the module in plain Python."""
    total, n, with_kind, both = len(rows), Counter(), Counter(), Counter()
    for _, text in rows:
        found = privacy.entities(text)
        kinds = {k for k, _, _ in found}
        terms = {w.lower() for w in privacy.WORD.findall(privacy.outside(text or "", [x[1:] for x in found]))}
        n.update(terms)
        with_kind.update(kinds)
        both.update((k, t) for k in kinds for t in terms)
    out = {}
    for (k, t), b in both.items():
        z = privacy.CONFIDENCE
        low = (b + z * z / 2 - z * math.sqrt(b * (n[t] - b) / n[t] + z * z / 4)) / (n[t] + z * z)
        share = math.log2(low * total / with_kind[k]) / math.log2(total / with_kind[k])
        if share >= privacy.DISCLOSURE:
            out[t] = max(share, out.get(t, 0))
    return out


@pytest.mark.parametrize("parts", [1, 8])
def test_disclosing_terms_by_brute_force(spark, parts):
    rows = private_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    private, clean = privacy.sanitise(frame)
    got = {}
    for r in private.collect():
        for s in r.spans:
            if s["kind"] == privacy.TERM:
                word = dict(rows)[r.doc_id][s["start"]:s["end"]].lower()
                got[word] = s["disclosure"]
        assert "who" not in r.text and "zorba" not in r.text.lower()
        assert "[EMAIL]" in r.text
    want = plain_disclosure(rows)
    assert set(got) == set(want) and {"zorba", "x9k2m", "quiet", "mail"} <= set(want) and "river" not in want
    assert all(got[t] == pytest.approx(want[t]) for t in want)
    assert clean.count() + private.count() == len(rows)


def test_clean_counts_send_a_term_once_a_task(spark):
    rows = [(i, "alpha beta " + "gamma " * (i % 2)) for i in range(2000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    terms = spark.createDataFrame([("alpha",), ("gamma",)], "term string")
    counts = privacy.clean_counts(frame, terms)
    got = {r.term: r.n_clean for r in counts.collect()}
    assert (got["alpha"], got["gamma"]) == (2000, 1000)
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_classes_of_terms():
    text = "Zorba x9k2m quiet a@b.cd"
    spans = [{"kind": "term", "start": 0, "end": 5, "disclosure": 0.6},
             {"kind": "term", "start": 6, "end": 11, "disclosure": 0.6},
             {"kind": "term", "start": 12, "end": 17, "disclosure": 0.95},
             {"kind": "email", "start": 18, "end": 24, "disclosure": None}]
    assert privacy.hide(text, spans) == "[NAME] [CODE]  [EMAIL]"


def test_encoding_query_of_hostile_rows(spark, table, rows, monkeypatch):  # noqa: F811
    # Some texts are long enough here to be encoded in pieces and joined.
    monkeypatch.setattr(tokens.encode_documents, "__defaults__", (
        *tokens.encode_documents.__defaults__[:4], 5000, None))
    tokenizer = tokens.load_tokenizer(tokens.tokenizer_path())

    def plain(doc_id, text):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        return (doc_id, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(),
                hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest())

    got = Counter(tuple(r) for r in queries.op4_tree_bpe(spark, table).collect())
    assert got == Counter(plain(r[0], r[1]) for r in rows)


def test_one_python_stage_encodes_and_decodes(docs, empty):  # noqa: F811
    coded = tokens.encode_documents(docs, keep=["doc_id"], decoded="back")
    plan = coded.filter("doc_id >= 0")._jdf.queryExecution().optimizedPlan().toString()
    short = plan.split("Join")[0]
    assert short.count("MapInArrow") == 2 and tokens.encode_documents(empty, decoded="back").count() == 0
    for wrong in ({"ids": "TEXT"}, {"decoded": "Lang"}):
        with pytest.raises(ValueError):
            tokens.encode_documents(docs, **wrong)
    with pytest.raises(ValueError):
        tokens.decode_documents(docs, ids="doc_id", text="TEXT")


def test_pieces_of_any_length_and_whole_words():
    import numpy as np

    from plyclock.llm import langid

    pieces = langid.Pieces()
    assert pieces.longest > 8
    long = [p for p in pieces.pieces if len(p) > 8]
    rng = np.random.default_rng(4)
    chances = np.append(rng.random((len(pieces.pieces), 2)), np.zeros((1, 2)), axis=0)
    chances[:-1] /= chances[:-1].sum(axis=0)
    number = {p: i for i, p in enumerate(pieces.pieces)}

    def plain(word):
        # Exact sums with a wide exponent.
        sums = [[(1.0, 0)] * 2]
        for j in range(1, len(word) + 1):
            row = []
            for lang in range(2):
                terms = [(sums[i][lang][0] * chances[number[word[i:j]], lang], sums[i][lang][1])
                         for i in range(max(0, j - pieces.longest), j) if word[i:j] in number]
                top = max(e for _, e in terms)
                m, e = math.frexp(sum(math.ldexp(m, e - top) for m, e in terms))
                row.append((m, e + top))
            sums.append(row)
        return [math.log(m) + e * math.log(2) for m, e in sums[-1]]

    words = [long[0], long[-1] + long[7], b"understanding ", "日本語テキスト".encode() * 9 + b" ",
             b"internationalization" * 12 + b" ", b"x" * 700 + b" ", b"a", b" "]
    got = pieces.scores(words, chances)
    for word, scores in zip(words, got.tolist(), strict=True):
        assert scores == pytest.approx(plain(word), rel=1e-10)
    assert [len(p) for p in langid.in_parts([b"a"] * 5, 2)] == [2, 2, 1]
    assert [len(p) for p in langid.in_parts([b"a", b"a" * 50, b"a" * 99], 9, 100)] == [1, 1, 1]


def test_taken_names_raise(docs):  # noqa: F811
    from plyclock.llm import langid

    with pytest.raises(ValueError):
        langid.identify(docs.withColumnRenamed("n", "Score"), {})


def test_stages_with_clashing_columns(spark, sf_dir):
    import corpus_pipeline
    from plyclock.llm import common, langid

    plain = common.documents(spark, sf_dir)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "12 + 3")], "doc_id long, text string")
    plain = plain.unionByName(odd, allowMissingColumns=True)
    clashing = plain.selectExpr("*", "1 AS score", "2 AS Lang_Pred", "3 AS predicted", "4 AS _stat_chars")
    for stage in (corpus_pipeline.language, corpus_pipeline.quality):
        a, b = stage(spark, plain, sf_dir), stage(spark, clashing, sf_dir)
        assert a.columns == plain.columns and b.columns == clashing.columns
        ids = sorted(r.doc_id for r in a.collect())
        assert ids == sorted(r.doc_id for r in b.collect()) and 0 < len(ids) < plain.count()
        assert {(r.score, r.Lang_Pred, r.predicted) for r in b.collect()} == {(1, 2, 3)}
        if stage is corpus_pipeline.language:
            # Every document with a letter in it is kept but for those of unsure language.
            model = langid.fit_languages(common.documents(spark, sf_dir).filter(common.crc_mod3() != 1))
            want = langid.identify(plain, model).filter(f"score >= {corpus_pipeline.SURE} AND lang_pred <> 'und'")
            assert ids == sorted(r.doc_id for r in want.collect()) and min(ids) >= 0


def test_words_are_learned_by_column():
    """Plain words go to the library without a Python call for each, and get the ids of the whole text."""
    import pyarrow as pa

    path = tokens.tokenizer_path()
    encoder, full = tokens.WordEncoder(path, leaf=50), tokens.load_tokenizer(path)

    def one_by_one(word):
        raise AssertionError("a word was looked at by itself")

    encoder.plain.parts = one_by_one
    letters = [chr(i) for i in range(0x21, 0x250)] + ["ẞ", "￿", "K"]
    words = [c + more for c in letters for more in ("", "b", "B.", "?!", "a.b")] + ["x" * 60, "a\x01b", "\x01"]
    texts = [*words, " ".join(words), None, "", " ".join(reversed(words[::3]))] * 2
    flat, sizes = encoder.encode(pa.array(texts))
    at = 0
    for text, size in zip(texts, sizes.tolist(), strict=True):
        assert flat[at:at + size].tolist() == full.encode(text or "", add_special_tokens=False).ids, text
        at += size
    assert at == len(flat)
