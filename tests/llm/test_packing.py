import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import packing

from .helpers import documents

MODEL = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(text):
    return MODEL.encode(text, add_special_tokens=False).ids + [2]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aé'sZΣς .\n\t ́<|endoftx>1９界", max_size=40), min_size=1, max_size=5))
def test_word_by_word_ids_are_the_tokenizers(texts):
    got = packing.tokenizer("word_bpe_49k.json").encode([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids_of(t)[:-1] for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_plan_covers_each_piece_once_without_padding(lengths):
    seen, filled = [[] for _ in lengths], {}
    for i, start, take, sequence, at in packing.plan(lengths, 64):
        seen[i].append((start, take))
        assert filled.get(sequence, 0) == at
        filled[sequence] = at + take
    for n, parts in zip(lengths, seen, strict=True):
        assert [s for s, _ in sorted(parts)] == list(np.cumsum([0, *[t for _, t in sorted(parts)]])[:-1]) and sum(t for _, t in parts) == n
    assert all(n & (n - 1) == 0 for n in filled.values())
    assert sum(n < 64 for n in filled.values()) <= 6


def test_a_filling_is_the_closest_to_capacity():
    assert next(packing.fillings({7: 1, 5: 2, 4: 1}, 12))[1] == {7: 1, 5: 1}
    assert next(packing.fillings({7: 1, 6: 1, 4: 1}, 12))[1] == {7: 1, 4: 1}


def test_every_letter_below_the_short_cut():
    letters = [chr(c) for c in range(0x80, 0x260)]
    texts = [f(c) for c in letters for f in (str, "ab{}cd".format, "{}x".format, "Stra{}e.".format, "A{}".format)]
    got = packing.tokenizer("word_bpe_49k.json").encode([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids_of(t)[:-1] for t in texts]


def test_each_filling_is_the_best_of_all_subsets():
    rng = random.Random(8)
    for _ in range(150):
        capacity = rng.randrange(6, 40)
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 11))]
        counts = {n: lengths.count(n) for n in lengths}
        left = dict(counts)
        for times, use in packing.fillings(counts, capacity):
            flat = [n for n, k in left.items() for _ in range(k)]
            flat.remove(max(flat))
            first = max(left)
            sums = {0}
            for n in flat:
                sums |= {x + n for x in sums if x + n <= capacity - first}
            assert use[first] >= 1 and sum(n * k for n, k in use.items()) == first + max(sums)
            assert times >= 1 and all(left[n] >= k * times for n, k in use.items())
            left = {n: left[n] - times * use.get(n, 0) for n in left if left[n] > times * use.get(n, 0)}
        assert not left and not counts


def test_round_trip(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "Ánd", "of,", "x9"]) for _ in range(rng.choice([0, 3, 900, 5000, 9000]))) for _ in range(40)] + ["", None, "a\u0000b <|endoftext|> c"]
    got = packing.digest(packing.pack(documents(spark, texts), shard_bytes=60_000)).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        ids = ids_of(texts[r.doc_id] or "")
        assert r.start == by.get(r.doc_id, 0) and r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        by[r.doc_id] = r.start + r.length
    assert by == {i: len(ids_of(t or "")) for i, t in enumerate(texts)}
    sequences = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert all(n <= 4096 and n & (n - 1) == 0 for n in sequences.values())


def test_empty_table_null_ids_and_repeats(spark):
    assert packing.pack(documents(spark, [])).count() == 0
    got = packing.pack(documents(spark, [(None, "a b"), (None, "a b"), (5, "c"), (5, "c")]))
    assert sum(r.length for r in got.collect()) == 3 + 3 + 2 + 2


def test_equal_rows_spread_over_the_shards(spark):
    """Half of all rows have neither id nor text, and a fifth is one document: no shard is much larger than the others."""
    rows = [(None, None)] * 6_000 + [(10**6, "the same text again")] * 2_400 + [(i, f"text number {i} of its own") for i in range(3_600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    packed = packing.pack(docs, shard_bytes=4_000).withColumn("shard", F.shiftright("sequence_id", 32))
    sizes = sorted(r["count"] for r in packed.groupBy("shard").count().collect())
    assert len(sizes) > 20 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
    tokens = {r.doc_id: r.n for r in packed.groupBy("doc_id").agg(F.max("doc_tokens").alias("n")).collect()}
    assert packed.agg(F.sum("length")).first()[0] == sum(tokens[i] for i, _ in rows)


def test_release_leaves_what_is_not_its_own(spark, tmp_path):
    from tessera.llm import common
    from tessera.sources import store

    theirs = store.written(spark.range(5), "theirs")
    mine = common.cut(spark.range(3), "mine")
    common.release(spark)
    assert theirs.count() == 5 and not store.exists(spark, mine.cut_at)
