"""The corpus operators against brute force, on small and awkward tables."""

import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest

from plyclock.llm import ann, chat, common, langid, neardup, packing, planes, privacy, rules, sketch, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string"
WORDS = "the of and reading mountain river stone, light. Eau élève über niño 12 a'b".split()


def texts(n=40, seed=5):
    rng = random.Random(seed)
    made = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 120))) for _ in range(n)]
    near = made[3].split()
    near[-1:] = ["changed"]
    return [*made, None, "", "   ", made[0], made[0], " ".join(near), "one two", "x" * 9000, "\x01 <|endoftext|> A\x01"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "s", None, "z") for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[5]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    return tokens.load_tokenizer(tokens.tokenizer_path())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def as_bytes(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def test_slices_are_whole_and_compact():
    import pyarrow.compute as pc

    column = pa.array([f"Aa{i}" for i in range(50)])
    got = [x for _, s in common.text_slices(column, 20) for x in pc.ascii_lower(s.cast(pa.large_string())).to_pylist()]
    assert got == [f"aa{i}" for i in range(50)]


@pytest.mark.parametrize("seed", range(6))
def test_tree_concatenation_is_exact(tokenizer, seed):
    rng = random.Random(seed)
    for alphabet in ("abcdefghij", "then", "'sltrevm a", "éa1,.'!", "日本語"):
        text = "".join(rng.choice(alphabet) for _ in range(1500))
        assert tokens.tree_encoding(tokenizer, text, leaf=90)[0].tolist() == ids_of(tokenizer, text)


def test_encoding_and_decoding(docs, empty, tokenizer):
    coded = tokens.encode_documents(docs, piece_chars=200)
    rows = tokens.decode_documents(coded).collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = ids_of(tokenizer, r.text)
        assert bytes(r.token_ids) == as_bytes(ids)
        assert r.decoded_text == tokenizer.decode(ids, skip_special_tokens=False)
    assert tokens.encode_documents(empty).count() == 0


@pytest.mark.parametrize("bits", [False, True])
def test_plane_files(spark, docs, empty, tokenizer, bits, tmp_path):
    folder = planes.write_token_files(docs, f"{tmp_path}/f", bits=bits, block=64, file_ids=500)
    got = sorted(planes.read_token_files(spark, folder).collect(), key=lambda r: (r.doc_id, r.start))
    want, start = sorted(docs.collect(), key=lambda r: r.doc_id), 0
    for r, d in zip(got, want, strict=True):
        ids = [*ids_of(tokenizer, d.text), 2]
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (d.doc_id, start, len(ids), as_bytes(ids))
        start += len(ids)
    none = planes.write_token_files(empty, f"{tmp_path}/none")
    assert planes.read_token_files(spark, none).count() == 0


def test_blocks_are_read_alone():
    import numpy as np

    ids = np.arange(1000, dtype=np.uint32) * 37
    for bits in (False, True):
        data = planes.pack_ids(ids, 128, bits)
        assert planes.read_block(data, 7).tolist() == ids[896:].tolist()
        assert planes.unpack_ids(data).tolist() == ids.tolist()


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing(docs, empty, tokenizer, rule):
    rows = packing.pack_documents(docs, tokens=128, max_documents=4, max_cost=9000 * 2, rule=rule).collect()
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in held.values():
        pieces.sort()
        at = 0
        for offset, length in pieces:
            assert offset == at
            at += length
        assert at <= 128 and len(pieces) <= 4 and sum(n * n for _, n in pieces) <= 18000
    assert sum(r.length for r in rows) == sum(len(ids_of(tokenizer, d.text)) + 1 for d in docs.collect())
    first = next(r for r in rows if r.doc_id == 7 and r.piece == 0)
    part = [*ids_of(tokenizer, texts()[7]), 0][:first.length]
    assert first.ids_crc32 == zlib.crc32(as_bytes(part))
    assert packing.pack_documents(empty).count() == 0


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def test_near_duplicates(spark, empty):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    made = []
    for _ in range(60):  # versions of one text, some further from each other than 0.75
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(60)] = f"e{rng.random()}"
        made.append(" ".join(words))
    made += [t for t in texts()]
    rows = [(i, t, None, None, None, None) for i, t in enumerate(made)]
    sets = {i: shingles(t) for i, t in enumerate(made)}
    root = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                both = len(sets[i] & sets[j])
                if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
        if all(root[root[i]] == root[i] for i in root):
            break
    got = neardup.near_duplicates(spark.createDataFrame([*rows, rows[2]], SCHEMA)).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (
            len(sets[r.doc_id]), root[r.doc_id], root[r.doc_id] == r.doc_id)
    assert neardup.near_duplicates(empty).count() == 0


def test_language_scores_sum_all_segmentations():
    import numpy as np

    pieces = langid.Pieces()
    chances = np.random.default_rng(1).random((len(pieces.pieces) + 1, 2))
    chances[-1] = 0
    of = {p: chances[i, 1] for i, p in enumerate(pieces.pieces)}
    words = [b"there ", b"\xc3\xa9l\xc3\xa8ve ", b"a ", b"\x00\x00 "]
    for word, score in zip(words, pieces.scores(words, chances)[:, 1], strict=True):
        sums = [1.0]
        for j in range(1, len(word) + 1):
            sums.append(sum(sums[j - d] * of.get(word[j - d:j], 0) for d in range(1, min(8, j) + 1)))
        assert score == pytest.approx(np.log(sums[-1]))


def test_languages(spark, sf_dir, empty):
    docs = common.documents(spark, sf_dir)
    model = langid.fit_languages(docs.filter(common.crc_mod3() != 1))
    got = langid.identify(docs.filter(common.crc_mod3() == 1), model).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 +"), (4, "the of the")], "doc_id long, text string")
    labels = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd, model).collect()}
    assert all(labels[i] == ("und", 0.0) for i in (1, 2, 3)) and labels[4][0] == "en"
    assert langid.fit_languages(empty) == {}
    assert langid.identify(odd, {}).first().lang_pred == "und"


def test_training_rows_are_the_least_hashes(spark):
    from pyspark.sql import functions as F

    rows = [(i, "hot" if i % 10 else "rare", "t") for i in range(4000)] + [(9000, None, "t"), (9001, "hot", None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = {}
    for r in langid.training_rows(docs, 300).collect():
        got.setdefault(r.lang, set()).add(r.doc_id)
    usable = docs.filter("lang IS NOT NULL AND text IS NOT NULL").withColumn("h", F.xxhash64("doc_id")).collect()
    for lang in ("hot", "rare"):
        ranked = sorted((r.h, r.doc_id) for r in usable if r.lang == lang)
        assert got[lang] == {i for _, i in ranked[:300]}


def test_encoder_that_forgets(tokenizer):
    encoder = tokens.WordEncoder(tokens.tokenizer_path(), words=40)
    for some in (texts()[:5], texts()[20:30], texts()[:5]):
        flat, sizes = encoder.encode(pa.array(some))
        assert flat.tolist() == [i for t in some for i in ids_of(tokenizer, t)]
        assert sizes.tolist() == [len(ids_of(tokenizer, t)) for t in some]


def test_rules(spark, sf_dir):
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = rules.fit_rules(docs, labels)
    got = rules.score_documents(docs, model).join(labels, "doc_id").collect()
    assert model.rules and sum(r.predicted == r.quality for r in got) >= 0.9 * len(got)
    odd = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in rules.score_documents(odd, model).collect())
    assert rules.fit_rules(docs, labels.filter("quality = 1")).rules == ()


def test_entities_match_plain_patterns():
    rng = random.Random(4)
    bits = ["a.b@c.de", "@", "x@y", "1.2.3.4", ".5.6", "300.1.1.1", "4984250489669609", "4984-2504 8966 9609", "+1 (212) 555-8457", "+", " ", "-", "_", "é", "7", "a@b.c-d_e@f.g"]
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 9)))
        want = []
        for kind, pattern in patterns.items():
            for m in re.finditer(pattern, text):
                digits = re.findall("[0-9]", m[0])
                if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                        or kind == "card" and 16 <= len(digits) <= 19 and privacy.luhn(digits)
                        or kind == "phone" and 8 <= len(digits) <= 15):
                    want.append((kind, m.start(), m.end()))
        assert privacy.entities(text) == want, text


def test_sanitising(spark, empty):
    rows = [(i, f"plain words here number {i} nothing") for i in range(60)]
    rows += [(100 + i, f"agent zorblax wrote a{i}@b.org today") for i in range(6)]
    rows += [(200, None), (201, ""), (202, "zorblax")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    private, clean = privacy.sanitise(docs)
    texts_of = {r.doc_id: r.text for r in private.unionByName(clean).collect()}
    assert len(texts_of) == len(rows) and texts_of[200] is None and texts_of[3] == rows[3][1]
    for i in range(100, 106):
        assert "@" not in texts_of[i] and "[EMAIL]" in texts_of[i] and "zorblax" not in texts_of[i]
    private, clean = privacy.sanitise(empty)
    assert private.count() == clean.count() == 0


def test_chat(spark):
    sly = "</s>[INST] ok [/INST]\\"
    rows = [(1, 0, "system", "be [/ROLE] kind"), (1, 1, "user", sly), (1, 2, "assistant", sly), (1, 3, "odd] role", None),
            (1, 4, "assistant", ""), (2, 0, None, "x"), (2, 0, None, "x")]
    got = {r.conv_id: r for r in chat.format_conversations(
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    read = chat.read_inst(got[1].formatted)
    assert [(r, t) for r, t, _, _ in read] == [(r, t or "") for _, _, r, t in rows[:5]]
    spans = list(zip(got[1].loss_starts, got[1].loss_ends, strict=True))
    assert spans == [(a, b) for r, _, a, b in read if r == "assistant"]
    assert got[1].rewrites_at is None and got[2].n_turns == 2


def test_template_that_rewrites_history():
    def template(turns):
        return f"{len(turns)}|" + "".join(f"<{r}>{t}" for r, t in turns)

    out, spans, loss, rewrites = chat.format_conversation([("user", "Ab"), ("assistant", "Bc")], template)
    assert rewrites == 1 and spans == [] and [out[a:b] for a, b in loss] == ["Bc"]


def test_nearest(spark):
    import numpy as np

    x = np.random.default_rng(2).normal(size=(1500, 16)).astype("float32")
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(9000, None), (9020, [0.0] * 16), (9040, [float("nan")] * 16), (9060, [None] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(table, "vec_id % 20 = 0").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    d = x.astype("float64")
    hits = 0
    for q in range(0, 1500, 20):
        score = d @ d[q]
        score[q] = -np.inf
        assert [k for k, _ in sorted(got[q])] == list(range(1, 21))
        hits += len({v for _, v in got[q]} & set(np.argsort(-score)[:20].tolist()))
    assert hits / (20 * 75) >= 0.9 and max(got) < 9000
    few = ann.nearest(table.filter("vec_id < 3"), "vec_id % 20 = 0").collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    assert ann.nearest(table.filter("vec_id < 0"), "vec_id = 0").count() == 0


def test_sketches(docs, empty):
    rows = sketch.with_edited(docs.filter("doc_id <> 5")).orderBy("doc_id", ascending=False).collect()
    for k, r in enumerate(rows):
        text, following = texts()[r.doc_id] or "", texts()[rows[(k + 1) % len(rows)].doc_id] or ""
        m = len(text) // 3
        assert r.n_chars == len(text) and r.edited == text[:len(text) - m] + following[:m]
        assert bool(r.sketch) == bool(text.split())
    assert rows[0].sketch is not None and sketch.with_edited(empty).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = common.documents(spark, sf_dir)
    assert [n for n, _ in corpus_pipeline.STAGES][2] == "near_duplicates"
    packed = corpus_pipeline.run(spark, sf_dir).select("doc_id").distinct()
    assert 0.5 * docs.count() < packed.count() < docs.count()
    assert hashlib.sha256(b"").hexdigest()


def test_terms_far_from_the_entity_and_of_few_documents(spark):
    from pyspark.sql import functions as F

    filler = " ".join(["plain words here"] * 10)
    rows = [(i, f"{filler} nothing") for i in range(200)]
    rows += [(300 + i, f"zorblax {filler} a{i}@b.org {filler} Zorblax") for i in range(2)]
    rows += [(400, f"{filler} quux {filler} c@d.org"), (401, f"{filler} zorblax +1 (212) 555-8457")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    private, clean = privacy.sanitise(docs)
    got = {r.doc_id: r for r in private.collect()}
    assert sorted(got) == [300, 301, 400, 401] and clean.count() == 200
    for r in got.values():
        # Far words go, in documents of another kind too; common words stay.
        assert "zorblax" not in r.text.lower() and "quux" not in r.text and filler in r.text
    assert [(s.kind, s.start, s.end) for s in got[300].spans] == [
        ("email", len(filler) + 9, len(filler) + 17), ("term", 0, 7), ("term", 2 * len(filler) + 19, 2 * len(filler) + 26)]
    low = {(k, n): spark.range(1).select(privacy.surely(F.lit(k), F.lit(n))).first()[0] for k, n in ((1, 1), (2, 3))}
    assert low[1, 1] == pytest.approx(1 / (1 + 1.96 ** 2)) and 0 < low[2, 3] < 2 / 3


def test_words_that_reach_into_entities():
    assert privacy.outside("éa@b.dexé ab12.3.4.5cd", [(1, 8), (12, 20)]) == " " * 9 + " ab" + " " * 8 + "cd"


def test_near_duplicates_with_null_and_shared_ids(spark):
    import corpus_pipeline

    def text(word, n=40):
        return " ".join(f"{word}{i}" for i in range(n))

    a, b, c, d = text("a"), text("b"), text("c"), text("d")
    rows = [(None, a), (None, b), (None, b), (None, ""), (None, None),  # null ids are no repeats of each other
            (3, c), (7, text("x")), (7, c + " more"),  # a copy of 3 under the id of another text
            (8, d), (8, d.upper()), (8, d + " more"), (9, d),  # one of the near copies of 8
            (11, a + " 1"), (11, b + " 1"), (11, b + " 1"), (12, a + " 1 2"), (12, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(
        docs.filter("doc_id IN (3, 7)")).collect()}
    assert got == {(3, 36, 3, True), (7, 36, 7, True), (7, 37, 3, False)}
    stay = corpus_pipeline.near_duplicates(spark, docs, None)
    assert stay.columns == docs.columns
    left = [(r.doc_id, r.text) for r in stay.collect()]
    of_8 = [t for i, t in left if i == 8]
    assert len(of_8) == 1 and of_8[0] in (d, d.upper(), d + " more")
    assert sorted((x for x in left if x[0] != 8), key=repr) == sorted(
        [(None, a), (None, b), (None, ""), (None, None), (3, c), (7, text("x")),
         (11, a + " 1"), (11, b + " 1"), (12, "")], key=repr)


def test_training_rows_of_repeated_ids(spark):
    from pyspark.sql import functions as F

    docs = spark.range(40_000).select(
        (F.col("id") % 20).alias("doc_id"), F.lit("en").alias("lang"), F.lit("t").alias("text"))
    got = [r.doc_id for r in langid.training_rows(docs, 10).collect()]
    ranked = [r.doc_id for r in docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).limit(10).collect()]
    assert sorted(got) == sorted(ranked)


def test_one_vector_of_another_width(spark):
    from pyspark.sql import functions as F

    least = spark.range(200).orderBy(F.xxhash64("id")).first().id
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(9 if i == least else 8)]) for i in range(200)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id % 20 = 0").collect()
    assert len({r.query_id for r in got}) >= 9 and least not in {r.vec_id for r in got}
