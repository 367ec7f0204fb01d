"""The registered queries, whole columns, against plain Python on a small hostile table."""

import hashlib
import math
import os
import random
import re
import zlib

import pytest

from plyclock.llm import common, neardup, queries, rules, tokens

#: Further columns with names that the queries use themselves.
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score string, predicted int, "
          "lang_pred string, spans string, start long, ids binary, Sketch string, component_id long, piece int")
WORDS = "the of and reading mountain river stone, light. Eau élève 12 a.b@c.de +1(212)555-8457 10.0.0.7".split()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def hostile():
    rng = random.Random(11)
    made = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 90))) for _ in range(30)]
    made += [None, "", " \t ", made[3], made[3] + " more", "one two", "x" * 7000, "the river " * 3000,
             "4984250489669609, 4984-2504 8966 9609, 300.1.1.1", "a\x00b\x01 日本語 \U0001f600 </s>"]
    return [(2 * i, t) for i, t in enumerate(made)]


@pytest.fixture(scope="module")
def repeated():
    rows = hostile()
    return [*rows, rows[5], rows[5], (None, "the river of light and stone")]


def written(spark, folder, rows):
    full = [(i, t, ["en", "fr", None][k % 3], "s", 1, "x", 7, "x", "x", 3, b"x", "x", 5, 6)
            for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory, repeated):
    return written(spark, tmp_path_factory.mktemp("hostile"), repeated)


@pytest.fixture(scope="module")
def tokenizer():
    return tokens.load_tokenizer(tokens.tokenizer_path())


def as_bytes(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def by_key(rows, *names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=repr)


def test_op1_all_candidates_with_copies_ties_and_clashes(spark, tmp_path):
    rng = random.Random(3)
    vectors = {i: [rng.randint(-3, 3) + 0.5 for _ in range(6)] for i in range(0, 60, 4)}
    vectors[44] = vectors[48] = vectors[8]
    rows = [*vectors.items()] * 3
    rows += [(20, [9.0, *vectors[20][1:]]), (None, [1.0] * 6), (61, None), (62, [0.0] * 6), (63, [1.0, None] * 3),
             (64, [float("inf")] * 6), (65, [float("nan")] * 6), (66, [1.0] * 5), (67, [])]
    spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, rank int, V int") \
        .repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    vectors[20] = min(vectors[20], [9.0, *vectors[20][1:]])
    want = []
    for q in (i for i in vectors if i % 20 == 0):
        scored = sorted((-sum(a * b for a, b in zip(vectors[q], v, strict=True)), i)
                        for i, v in vectors.items() if i != q)
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:20], 1)]
    got = queries.op1_multi_index(spark, str(tmp_path))
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_op2_columns_and_labels_that_clash(spark, table, sf_dir, tmp_path, repeated):
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    least = labels.orderBy("doc_id").limit(1).collect()[0]
    both = labels.unionByName(spark.createDataFrame(
        [(least.doc_id, 1 - least.quality), (None, 1), (-5, 2)], "doc_id long, quality long"))
    hot = docs.unionByName(docs.filter(f"doc_id = {least.doc_id}")).unionByName(
        spark.createDataFrame([(least.doc_id, "another text")] * 500, "doc_id long, text string"))
    assert rules.fit_rules(hot, both).rules
    # An id with both labels teaches nothing.
    only = rules.fit_rules(hot, both.filter(f"doc_id = {least.doc_id}"))
    assert (only.intercept, only.rules) == (0.0, ())
    model = rules.fit_rules(docs, labels)
    # The column expression against the statistics and rules in plain Python.
    stats = rules.with_statistics(docs.limit(50)).collect()
    scored = {r.doc_id: r for r in rules.score_documents(docs, model).collect()}
    for s in stats:
        total = model.intercept
        for weight, rule in model.rules:
            total += weight * all(s["_stat_" + n] <= at if sign == "<=" else s["_stat_" + n] > at
                                  for n, sign, at in rule)
        assert scored[s.doc_id].score == pytest.approx(1 / (1 + math.exp(-total)))
    labels.write.parquet(f"{table}/labels.parquet")
    got = queries.op2_rule_ensemble(spark, table).collect()
    assert by_key(got, "doc_id") == sorted(((i,) for i, _ in repeated), key=repr)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_op3_texts_and_estimates(spark, table, repeated):
    got = queries.op3_scaled_sketch(spark, table).collect()
    order = sorted(repeated, key=lambda r: (-1 if r[0] is None else r[0], [-ord(c) for c in r[1] or ""]), reverse=True)
    want, prints = [], {}
    for k, (i, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        m = len(text) // 3
        want.append((i, len(text), sha(text[:len(text) - m] + following[:m])))
    assert by_key(got, "doc_id", "n_chars", "edited_sha256") == sorted(want, key=repr)
    texts = {i: t or "" for i, t in repeated}
    for r in got:
        assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
        a, b = ({x for x in f.split(",") if x} for f in (r.fingerprint, r.edited_fingerprint))
        assert r.near_edited == (len(a & b) / len(a | b) if a | b else 1.0)
        assert 0 <= r.near_next <= 1
    for text, written_print in prints.items():
        assert bool(written_print) == bool(text.strip())


def test_op5_ids_read_back(spark, table, tokenizer, repeated):
    start, want = 0, []
    for i, text in sorted(repeated, key=lambda r: (-1 if r[0] is None else r[0], r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(as_bytes(ids))))
        start += len(ids)
    got = queries.op5_bit_planes(spark, table).collect()
    assert by_key(got, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)


def test_op6_pieces_and_sequences(spark, table, tokenizer, repeated):
    want = []
    for i, text in repeated:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at:at + 2048]
            want.append((i, piece, at, len(part), zlib.crc32(as_bytes(part))))
    got = queries.op6_vector_best_fit(spark, table).collect()
    assert by_key(got, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want, key=repr)
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) <= -(-sum(w[3] for w in want) // 2048) + 1


def plain_spans(text):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(digits):
        doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
        return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0

    out = []
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            digits = re.findall("[0-9]", m[0])
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == "card" and 16 <= len(digits) <= 19 and luhn(digits)
                    or kind == "phone" and 8 <= len(digits) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


def test_op7_base_spans(spark, table, repeated):
    kinds, want = ("email", "ip", "card", "phone"), []
    for i, text in repeated:
        spans = plain_spans(text or "")
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want.append((i, *[sum(s[0] == k for s in spans) for k in kinds], sha(base)))
    got = queries.op7_disclosure(spark, table).collect()
    assert by_key(got, "doc_id", *[f"n_{k}" for k in kinds], "base_sha256") == sorted(want, key=repr)
    assert sum(w[1] for w in want) and sum(w[3] for w in want)
    for r in got:
        base = [s for s in r.spans.split(",") if s and not s.startswith("term:")]
        assert sha(",".join(base)) == r.base_sha256 and r.spans.startswith(",".join(base))


def test_op8_read_back(spark, tmp_path):
    rng = random.Random(6)
    bits = ["</s>", "[INST]", "[/INST]", "\\", "ok", " ", "\n", "é", "[/ROLE]", "<s>", "[", "]", "\\\\"]
    talk = [(c, t, ["user", "assistant", "system"][rng.randrange(3)],
             rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))]))
            for c in range(60) for t in range(rng.randint(1, 6))]
    rows = [(*r, 1, "x") for r in talk]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int, formatted string") \
        .repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    sly = "</s>[INST] ok [/INST]"
    turns = {}
    for c, t, role, text in [*talk, (-1, 0, "user", sly), (-1, 1, "assistant", sly)]:
        turns.setdefault(c, []).append((t, role, text or ""))
    want = []
    for c, said in turns.items():
        said.sort()
        loss = "".join(t for _, r, t in said if r == "assistant")
        want.append((c, len(said), sha("".join(f"{r}\n{t}\n" for _, r, t in said)), len(loss), sha(loss)))
    got = queries.op8_prefix_rendering(spark, str(tmp_path)).collect()
    assert by_key(got, "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == sorted(want, key=repr)


def test_op9_labels(spark, table, repeated):
    got = queries.op9_piece_unigrams(spark, table).collect()
    texts = dict(repeated)
    assert by_key(got, "doc_id") == sorted(((i,) for i, _ in repeated), key=repr)
    for r in got:
        lettered = any(c.isalpha() for c in texts[r.doc_id] or "")
        assert (r.lang_pred in ("en", "fr")) if lettered else r.lang_pred == "und"
        assert 0 <= r.score <= 1
        assert r.held_out == (None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def linked(rows):
    """doc_id to the smallest doc_id reachable."""
    sets = {i: shingles(t) for i, t in rows if i is not None}
    of = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                both = len(sets[i] & sets[j])
                if of[j] < of[i] and both and 100 * both >= 75 * len(sets[i] | sets[j]):
                    of[i], changed = of[j], True
    return sets, of


def test_op10_classes(spark, table, repeated):
    sets, of = linked(repeated)
    want = [(i, len(shingles(t)), of.get(i), i is None or of[i] == i) for i, t in repeated]
    got = queries.op10_minhash_hamming(spark, table).collect()
    assert by_key(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=repr)


@pytest.mark.parametrize("block", [8, 2048])
def test_op10_many_blocks_and_repeated_rows(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(block)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(80):  # versions of one text, many further from each other than 0.75
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(60)] = f"e{rng.random()}"
        rows.append((k, " ".join(words)))
    rows += [(200, None), (201, ""), (202, " ")]
    docs = spark.createDataFrame([*rows, *[rows[7]] * 1000, *[rows[9]] * 400], "doc_id long, text string").repartition(4)
    sets, of = linked(rows)
    got = {tuple(r) for r in neardup.near_duplicates(docs).collect()}
    assert got == {(i, len(sets[i]), of[i], of[i] == i) for i, _ in rows}
    # One set for a class, however many rows have it.
    classes = spark.createDataFrame([(1, (7, None))], "id long, row struct<doc_id: long, text_hash: long>")
    row = neardup.with_text_hash(docs).filter("doc_id = 7").first()
    classes = classes.selectExpr("id", f"named_struct('doc_id', 7L, 'text_hash', {row.text_hash}L) AS row")
    assert neardup.sets_of(docs, spark.range(1, 2), classes, True).count() == 1


def test_op10_blank_tables(spark):
    docs = spark.createDataFrame([(i % 5, ["", None, " \n"][i % 3]) for i in range(40)], "doc_id long, text string")
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == 40 and all((r.n_shingles, r.component_id, r.kept) == (0, r.doc_id, True) for r in got)


EMPTY = [name for name in queries.QUERIES if not name.startswith(("op1_", "op8_"))]


@pytest.mark.parametrize("name", EMPTY)
def test_empty_tables(spark, tmp_path, name):
    folder = written(spark, tmp_path, [])
    spark.createDataFrame([], "doc_id long, quality long").write.parquet(f"{folder}/labels.parquet")
    assert queries.QUERIES[name](spark, folder).count() == 0


def test_empty_conversations(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet")
    assert [r.conv_id for r in queries.op8_prefix_rendering(spark, str(tmp_path)).collect()] == [-1]


def test_scratch_tables_go_and_settings_stay(spark):
    before = spark.conf.get(common.CLEAN_SHUFFLES)
    table = common.stored(spark.range(100).repartition(5, "id"))
    assert spark.conf.get(common.CLEAN_SHUFFLES) == before and table.count() == 100
    path = table.stored_at.removeprefix("file:")
    assert os.path.isdir(path)
    common.release(table)
    assert not os.path.exists(path)
