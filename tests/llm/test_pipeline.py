import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import common, decontaminate

from .helpers import documents
from .test_decontaminate import brute as leaks
from .test_lines import brute as line_brute
from .test_simhash import brute_near

STAGE = dict(corpus_pipeline.STAGES)


def odd(spark):
    rows = ["the of and is a line of words", None, "", "12 34", "the of and is a line of words", "x\nthe of and is a line of words\nnew line here", (None, "null id row here now then"), (None, "null id row here now then"), (70, "same id"), (70, "same id"), (70, "other text")]
    return documents(spark, rows)


def test_stages_keep_the_columns_on_odd_rows(spark):
    docs = odd(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        sf = "/root/testdata/sf0.001"
        got = stage(spark, docs, sf)
        assert got.schema.simpleString() == docs.schema.simpleString(), name
        rows = got.collect()
        assert rows or name != "language ID"
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    assert corpus_pipeline.pack(spark, docs.limit(0), sf).count() == 0


def test_language_id_rejects_what_has_no_letter(spark):
    assert [r.text for r in STAGE["language ID"](spark, odd(spark), "").collect() if not any(c.isalpha() for c in r.text or "")] == []
    assert STAGE["language ID"](spark, odd(spark), "").count() == 8


def test_line_dedup(spark):
    got = {(r.doc_id, r.text, r.n_chars, r.block) for r in STAGE["line dedup"](spark, odd(spark), "").collect()}
    assert (0, "the of and is a line of words", 29, "x") in got and (5, "x\nnew line here", 15, "x") in got
    assert not any(d == 4 for d, *_ in got) and sum(d is None for d, *_ in got) == 1


def test_near_dedup_keeps_one_of_each_group(spark):
    got = [(r.doc_id, r.text) for r in STAGE["SimHash near-dedup"](spark, odd(spark), "").collect()]
    want = [(0, "the of and is a line of words"), (1, None), (3, "12 34"), (5, odd(spark).filter("doc_id = 5").first().text), (None, "null id row here now then"), (70, "same id"), (70, "other text")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_pipeline_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in common.table(spark, sf, "documents").collect()]
    docs = [(d, t) for d, t in docs if any(c.isalpha() for c in t or "")]
    from tessera.llm import lines

    kept = {r.doc_id: r.kept for r in lines.dedup(documents(spark, docs)).collect()}
    assert sorted((d, h) for d, _, _, h in line_brute(docs)) == sorted((d, __import__("hashlib").sha256(k).hexdigest()) for d, k in kept.items())
    docs = [(d, kept[d].decode()) for d, t in docs if kept[d].split() or t == kept[d].decode()]
    docs.sort()
    group, _ = brute_near([t for _, t in docs])
    first = {docs[g][0] for g in group}
    stay = {r.doc_id for r in STAGE["SimHash near-dedup"](spark, documents(spark, docs), sf).collect()}
    assert first <= stay and len(stay - first) <= 0.05 * (len(docs) - len(first))
    docs = [(d, t) for d, t in docs if d in stay]
    items = [(r.item_id, r.text) for r in common.table(spark, sf, "benchmark").collect()]
    clean = [decontaminate.normalise(t.encode())[0].tobytes() for _, t in items]
    leaked = {d for d, t in docs if any(c.strip() in decontaminate.normalise(t.encode())[0].tobytes() for c in clean)}
    got = corpus_pipeline.run(spark, sf).collect()
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {d: len(model.encode(t, add_special_tokens=False).ids) + 1 for d, t in docs}
    have = {}
    for r in got:
        have[r.doc_id] = have.get(r.doc_id, 0) + r.length
    assert set(have) <= set(want) - leaked and all(have[d] == want[d] for d in have)
    gone = set(want) - set(have)
    assert gone >= leaked and all(leaks([x for x in docs if x[0] == d], items) for d in gone - leaked)
