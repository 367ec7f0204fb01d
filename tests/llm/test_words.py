"""Pieces, phrases and spelling variants against plain versions, on awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from plyclock.llm import phrases, pieces, queries, variants

SCHEMA = "doc_id long, text string, lang string, word string, n long, Slice string"
WORDS = "The of and reading rading readings mountain Mountan mountains river stone, light. Élève élèves niño 12 a'b".split()


def texts(n=60, seed=7):
    rng = random.Random(seed)
    made = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 150))) for _ in range(n)]
    return [*made, None, "", "   ", " \t\n ", made[0], made[0], "one two.two\none", "x" * 9000, "ab" * 3000,
            "a\x00b  c \x01 </s> <0x0A> ▁▁ 日本語 \U0001f600", "of the " * 2000]


@pytest.fixture(scope="module")
def rows():
    made = [(i, t, [None, "en", "de"][i % 3], "z", 1, "s") for i, t in enumerate(texts())]
    return [*made, made[4], (None, "The reading reading mountains", "en", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def table(tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


# Pieces

@pytest.fixture(scope="module")
def encoder():
    return pieces.PieceEncoder(pieces.model_path(), units=50, pairs=40)


@pytest.mark.parametrize("seed", range(4))
def test_backtracking_is_exact(encoder, seed):
    rng = random.Random(seed)
    alphabet = "abcdeéñ ▁ \n.'12日🎉\x00<>/s"
    made = ["".join(rng.choice(alphabet[:2] if i % 5 == 0 else alphabet) for _ in range(rng.randint(0, 80)))
            for i in range(400)]
    made += ["a" * 4000, " " * 333, "▁" * 77, "aab" * 999]
    flat, counts = encoder.encode(pa.array(made))
    decoded, at = encoder.decode(flat, counts).to_pylist(), 0
    for text, n, back in zip(made, counts, decoded, strict=True):
        want = encoder.model.encode(text)
        assert flat[at:at + n].tolist() == want
        assert back == encoder.model.decode(want)
        at += n


def test_compatible_pairs_by_merging(encoder):
    rng = random.Random(1)
    some = [p for p in encoder.pieces if "▁" not in p]
    for _ in range(300):
        a, b = rng.choice(some), rng.choice(some)
        got = encoder.model.encode("▁".join(["", a + b]))
        split = [encoder.model.id_to_piece(i) for i in got]
        # Behind a blank the first piece may be another, so only plain merging is compared.
        assert "".join(split).lstrip("▁") == (a + b).lstrip("▁")
        assert encoder.fits(encoder.pieces[a], encoder.pieces[b]) == (encoder.merged(a + b) == [a, b])


def test_pieces_query(spark, table, rows, encoder):
    got = Counter(tuple(r) for r in queries.op11_backtracking_pieces(spark, table).collect())

    def plain(doc_id, text):
        ids = encoder.model.encode(text or "")
        return (doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256(encoder.model.decode(ids).encode()).hexdigest())

    assert got == Counter(plain(r[0], r[1]) for r in rows)


def test_pieces_keep_columns_and_round_trip(docs, empty, encoder):
    coded = pieces.encode_documents(docs)
    assert coded.columns == [*docs.columns, "piece_ids"]
    for r in pieces.decode_documents(coded.select("text", "piece_ids")).collect():
        assert r.decoded_text == encoder.model.decode(encoder.model.encode(r.text or ""))
    assert pieces.encode_documents(empty, decoded="back").count() == 0
    with pytest.raises(ValueError):
        pieces.encode_documents(docs, ids="TEXT")


def test_any_ids_decode(spark, encoder):
    given = [[259, 259, 5], [29871], [1, 29871, 5], [229], [0], [2, 13], [], None, [3 + 0xE2, 300]]
    table = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, ids array<int>").coalesce(1)
    got = {r.i: r.decoded_text for r in pieces.decode_documents(table, ids="ids").collect()}
    assert got == {i: None if g is None else encoder.model.decode(g) for i, g in enumerate(given)}


# Phrases

def plain_phrases(rows, least, longest, top):
    counts, totals = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, found in counts.items():
        kept = []
        often = {p: f for p, f in found.items() if f >= least}
        for p, a in often.items():
            if len(p) < 2 or any(len(q) > len(p) and f >= a and any(
                    q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, f in often.items()):
                continue
            n = totals[lang]
            score, _, l, r = min((1000 * a * n // (found[p[:k]] * found[p[k:]]), k, found[p[:k]], found[p[k:]])
                                 for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r, n))
        for rank, (s, a, p, l, r, n) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -s))
    return sorted(out)


def test_phrases_by_brute_force(docs, rows, empty, monkeypatch):
    # Many slices, bundles and rounds.
    monkeypatch.setattr(phrases, "SLICE_BYTES", 2000)
    monkeypatch.setattr(phrases, "TOGETHER", 3)
    monkeypatch.setattr(phrases, "BUNDLE_WORDS", 500)
    monkeypatch.setattr(phrases, "LIST_WORDS", 5)
    got = phrases.mine_phrases(docs, least=4, top=150).collect()
    assert sorted(tuple(r) for r in got) == plain_phrases(rows, 4, 5, 150)
    assert {r.lang for r in got} == {"und", "en", "de"}
    assert phrases.mine_phrases(empty).count() == 0


def test_phrases_of_two_words_at_most(docs, rows):
    got = phrases.mine_phrases(docs, least=6, longest=2, top=20).collect()
    assert sorted(tuple(r) for r in got) == plain_phrases(rows, 6, 2, 20)


@pytest.mark.parametrize("high", [3, 40, 700, 5000])
def test_tiles_count_every_pair(high):
    import numpy as np

    rng = np.random.default_rng(high)
    x, y = (rng.integers(0, high, 30_000) ** 2 // high for _ in range(2))
    keys, counts = phrases.pair_counts(x, y, tile=4)
    want = Counter(zip(x.tolist(), y.tolist(), strict=True))
    assert {(int(k) >> 32, int(k) & 0xFFFFFFFF): int(c) for k, c in zip(keys, counts, strict=True)} == want
    assert (np.diff(keys) > 0).all()
    for none in (x[:0],):
        assert len(phrases.pair_counts(none, none)[0]) == 0


# Spelling variants

def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(rows, sparse, letters, least, ratio):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % sparse == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= letters and c >= least}
    near = {w: [o for o in n if o != w and is_near(w, o)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


@pytest.mark.parametrize("most", [2000, 3])
def test_variants_by_brute_force(docs, rows, empty, monkeypatch, most):
    rng = random.Random(9)
    grown = list(rows)
    for i in range(40):
        made = ["".join(rng.choice("abcé") for _ in range(rng.randint(4, 8))) for _ in range(60)]
        grown.append((1000 + i, " ".join(made * rng.randint(1, 6)), None, None, None, None))
    monkeypatch.setattr(variants, "LIST", most)
    monkeypatch.setattr(variants.near_words, "__defaults__", (most,))
    table = docs.sparkSession.createDataFrame(grown, SCHEMA)
    got = variants.spelling_variants(table, sparse=5, letters=4, least=3, ratio=2).collect()
    want = plain_variants(grown, 5, 4, 3, 2)
    assert sorted(tuple(r) for r in got) == want
    assert any(r.root not in (r.word, r.form) for r in got)
    assert variants.spelling_variants(empty).count() == 0


@pytest.mark.parametrize("alphabet", ["ab", "abcé"])
def test_sorted_lists_by_brute_force(alphabet):
    rng = random.Random(3)
    for _ in range(60):
        made = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 8))) for _ in range(60)})
        assert sorted(variants.near_in_list(made)) == [
            (i, j) for i in range(len(made)) for j in range(i + 1, len(made)) if is_near(made[i], made[j])]


def test_long_chains_of_forms(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(21)] + [("x", "w20")]
    got = variants.roots(spark.createDataFrame(chain, "word string, form string")).collect()
    assert {r.word: r.root for r in got} == {w: "w21" for w, _ in chain}
