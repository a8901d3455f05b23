import numpy as np

from tessera.llm import langid

from .helpers import documents


def grams(text):
    raw = bytes(langid._FOLD[list(text.encode())]) if text else b""
    raw = b" ".join(raw.split(b" ")) + b" "
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    found = set()
    for n in range(1, langid.N_MAX + 1):
        for i in range(len(raw) - n + 1):
            code = 0
            for b in raw[i : i + n]:
                code = (code * 257 + b + 1) % 2**32
            found.add((code * 0x9E3779B1) % 2**32 >> 32 - langid.BUCKETS.bit_length() + 1)
    return found


def test_kernel_is_the_normalised_number_of_common_ngrams():
    texts = ["The cat sat", "the  CAT, 9 sat on it", "été à la mer", "x", ""]
    k = langid.presence([t.encode() for t in texts])
    sets = [grams(t) for t in texts]
    for i, a in enumerate(sets[:4]):
        for j, b in enumerate(sets[:4]):
            assert abs(float(k[i] @ k[j]) - len(a & b) / np.sqrt(len(a) * len(b))) < 1e-4


def test_a_long_text_is_the_mean_of_its_pieces():
    text = bytes(np.random.default_rng(1).integers(97, 123, 3 * langid.PIECE - 7).astype(np.uint8))
    parts, of = langid.pieces([b"", text, b"x"])
    assert b"".join(parts) == text + b"x" and of.tolist() == [0, 1, 1, 1, 2] and max(map(len, parts)) <= langid.PIECE
    assert np.allclose(langid.presence([text])[0], langid.presence(parts[1:4]).mean(0), atol=1e-6)


def test_every_label_is_learned_however_many_copies_it_has(spark):
    base = spark.range(6 * 20_000).selectExpr("id doc_id", "concat('lang', id % 6) lang", "concat('the same text of ', element_at(array('uno', 'duo', 'tri', 'qua', 'pen', 'six'), cast(id % 6 as int) + 1)) text")
    more = spark.range(3_000).selectExpr("id + 1000000 doc_id", "'lang0' lang", "concat('uno words ', id) text")
    letterless = spark.range(30_000).selectExpr("id + 2000000 doc_id", "'lang1' lang", "concat('', id) text")
    rows = langid.training_rows(base.unionByName(more).unionByName(letterless)).collect()
    count = {f"lang{i}": sum(r.lang == f"lang{i}" for r in rows) for i in range(6)}
    assert count == {"lang0": langid.PER_LABEL} | {f"lang{i}": 1 for i in range(1, 6)}
    model = langid.fit(base)
    assert {(r.lang, r.lang_pred) for r in langid.predict(base.limit(600).unionByName(base.orderBy("doc_id").limit(6)), model, ("lang",)).collect()} == {(f"lang{i}", f"lang{i}") for i in range(6)}


def test_a_hundred_labels(spark):
    rng = np.random.default_rng(2)
    stems = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(100)]
    rows = [(i, " ".join(stems[i % 100] + rng.choice(["a", "o", "is", "um"]) for _ in range(12)), f"l{i % 100:02d}") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.training_rows(docs, 200, 400).groupBy("lang").count().collect() and langid.training_rows(docs, 200, 400).count() <= 400
    model = langid.fit(docs)
    assert len(model.labels) == 100
    got = langid.predict(docs, model, ("lang",)).collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97


def test_landmarks_at_all_rows_are_the_full_ridge_regression(spark):
    """Kernel ridge regression solved in the dual over the whole kernel matrix."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("lang is not null and length(text) between 40 and 3000").orderBy("doc_id").limit(60).collect()
    texts, labels = [r.text.encode() for r in rows], [r.lang for r in rows]
    model = langid.fit_rows(texts, labels, landmarks=10**6)
    x = langid.presence(texts).astype(np.float64)
    names = sorted(set(labels))
    y = np.array([[1.0 if r == n else -1.0 for n in names] for r in labels])
    k = x @ x.T
    h = np.eye(len(x)) - 1 / len(x)
    alpha = np.linalg.solve(h @ k @ h + langid.RIDGE * len(x) / 100 * np.eye(len(x)), h @ y)
    for new in (texts, [t[: len(t) // 2] for t in texts]):
        z = langid.presence(new).astype(np.float64) @ x.T
        want = (z - k.mean(0)) @ h @ alpha + y.mean(0)
        got = langid.scores(model, new)
        assert np.abs(got - want).max() < 2e-2 and (got.argmax(1) == want.argmax(1)).all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = langid.query(spark, sf).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    docs = documents(spark, ["the of and is", None, "", "12 ... 34", "é", "the of and is", (None, "the of")])
    model = langid.fit(docs)
    got = {(r.doc_id, r.lang_pred): r.score for r in langid.predict(docs, model).collect()}
    assert set(got) == {(0, "en"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "en"), (None, "en")}
    assert got[1, "und"] == 0 and got[0, "en"] == got[5, "en"]
    assert langid.fit(docs.limit(0)) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_lang_of_predicted_rows_and_long_texts_do_not_matter(spark):
    docs = documents(spark, ["the of and is " * 30, "der die das und " * 30])
    docs = docs.selectExpr("doc_id", "text", "if(doc_id = 0, 'en', 'de') lang")
    model = langid.fit(docs)
    long = documents(spark, ["und das die der " * 100_000, "of the is and " * 100_000])
    assert [r.lang_pred for r in langid.predict(long, model).orderBy("doc_id").collect()] == ["de", "en"]


def test_clean_rejects_what_is_no_language_and_keeps_short_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rng = np.random.default_rng(3)
    some = lambda letters, n: "".join(rng.choice(list(letters), n))
    junk = ["12 34 a 56 78 ...", "x" + "0123456789 " * 50, some("abcdefghijklmnopqrstuvwxyz    ", 300), some("QWERTYasdfgh0123456789+/", 2_000), some("абвгдежзийклмн    ", 200), "zq" * 100, "→ ★ " * 40]
    planted = spark.createDataFrame([(10**9 + i, t, None) for i, t in enumerate(junk)], table.schema)
    got = {r.doc_id for r in langid.clean(table.unionByName(planted)).collect()}
    assert got == {r.doc_id for r in table.filter(r"text rlike '\\p{L}'").collect()}
    assert table.filter("length(text) < 60").count() > 0
