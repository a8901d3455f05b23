import hashlib
import random

from tessera.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, chunk string, place int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA)


def made(seed, conversations=30, turns=9):
    rng = random.Random(seed)
    bits = ["<|im_end|>", "<|im_start|>", "<\\|im_end|>", "<|", "|>", "<\\\\|", "assistant\n", "mot é", "12345", " ", "\n", "語", "😀", "words of a turn "]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))
    return [(c, t, ("system" if t == 0 and c % 3 == 0 else ["user", "assistant", "tool\nx%0A%"][t % 3 if c % 5 == 0 else t % 2]), text()) for c in range(conversations) for t in range(turns)]


def expected(rows):
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort(key=lambda x: x[:2])
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        said = "".join(f"{x[2]}\n{x[3]}\n" for x in turns)
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def found(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_round_trip_with_hostile_texts(spark):
    rows = made(1) + [(None, 1, "user", "no id"), (None, 2, "assistant", "it"), (90, None, "user", "first"), (90, 0, "assistant", None), (91, 5, None, None)]
    df = frame(spark, rows)
    for budget, history in ((1024, 256), (60, 20), (60, 0), (1, 1), (10**6, 5)):
        assert found(chat.digest(chat.windows(df, budget, history))) == expected(rows)
    assert found(chat.digest(chat.windows(df, 60, 20, together=True))) == expected(rows)


def test_windows_keep_the_budget_the_system_turn_and_masks(spark):
    rows = made(2)
    cost = {(r.conv, r.t.turn): r.t.cost for r in chat._turns(frame(spark, rows)).collect()}
    system = {c for c, t, role, _ in rows if t == 0 and role == "system"}
    budget, history = 150, 40
    got = chat.windows(frame(spark, rows), budget, history).withColumn("turns", chat.read(chat.F.col("text"))).withColumn("learned", chat.learned(chat.F.col("text"), chat.F.col("loss"))).collect()
    assert len(got) > 60
    for c in {r.conv_id for r in got}:
        at = 0
        turns = sorted((t, role, text) for k, t, role, text in rows if k == c)
        for w in sorted((r for r in got if r.conv_id == c), key=lambda r: r.place):
            fresh = w.turns[w.repeated :]
            assert [(x.role, x.text) for x in fresh] == [x[1:] for x in turns[at : at + len(fresh)]] and fresh
            assert w.learned == [x.text for x in fresh if x.role == "assistant"]
            assert w.tokens <= budget or len(fresh) == 1
            again = w.turns[: w.repeated]
            if c in system and at:
                assert again[0].role == "system" and again[0].text == turns[0][2]
                again = again[1:]
            assert [(x.role, x.text) for x in again] == [x[1:] for x in turns[at - len(again) : at]]
            assert sum(cost[c, turns[i][0]] for i in range(at - len(again), at)) <= history
            # One turn more wouldn't have fitted.
            if at + len(fresh) < len(turns):
                assert w.tokens + cost[c, turns[at + len(fresh)][0]] > budget
            at += len(fresh)
        assert at == len(turns)


def test_long_conversations_are_many_rows(spark, monkeypatch):
    """A conversation of several stretches: each begins without history but with the system turn."""
    monkeypatch.setattr(chat, "CHUNK", 8)
    rows = [(1, t, "system" if t == 0 else ["user", "assistant"][t % 2], f"turn {t} of one") for t in range(100)] + [(2, t, ["user", "assistant"][t % 2], f"turn {t}") for t in range(40)] + [(None, t, "user", "none") for t in range(20)]
    df = frame(spark, rows)
    for most in (1 << 20, 0):  # system turns broadcast, and joined
        monkeypatch.setattr(chat, "MOST_SENT", most)
        out = chat.windows(df, 40, 10)
        assert found(chat.digest(out)) == expected(rows)
        first = out.filter("place = 0").select("conv_id", "chunk", "repeated", chat.read(chat.F.col("text"))[0].alias("t")).collect()
        assert len(first) == 13 + 5 + 3
        assert all(r.t.role == "system" and r.repeated == (r.chunk > 0) for r in first if r.conv_id == 1)
        assert all(r.repeated == 0 for r in first if r.conv_id != 1)


def test_ties_repeats_and_empty_tables(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "z")]
    (w,) = chat.windows(frame(spark, rows)).withColumn("turns", chat.read(chat.F.col("text"))).collect()
    assert [(t.role, t.text) for t in w.turns] == [("assistant", "z"), ("user", "a"), ("user", "a"), ("user", "b")]
    assert chat.digest(chat.windows(frame(spark, []))).count() == 0


def test_no_python_on_the_way(spark):
    plan = chat.digest(chat.windows(frame(spark, made(1)), together=True))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1
