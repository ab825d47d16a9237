"""Collapse of cumulative conversations against a plain version, with odd rows."""

import random

from pyspark.sql import functions as F

from entwine.llm import chat

TURNS = "conv_id long, turn long, role string, text string"


def plain(rows):
    """{conv_id: (n_turns, copies, rendered)} of the maximal conversations."""
    order = lambda r: tuple((x is not None, x) for x in r)
    logs = {}
    for c, *rest in set(rows):
        if c is not None:
            logs.setdefault(c, []).append(tuple(rest))
    logs = {c: [r[1:] for r in sorted(v, key=order)] for c, v in logs.items()}
    kept = {}
    for c, log in logs.items():
        if not any(len(o) > len(log) and o[: len(log)] == log for o in logs.values()):
            same = [d for d, o in logs.items() if o == log]
            kept[min(same)] = (len(log), len(same), "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in log))
    return kept


def check(spark, rows):
    df = spark.createDataFrame(rows, TURNS).withColumns({"part": F.lit("x"), "pos": F.lit(1), "_id": F.lit(None).cast("string"), "n_turns": F.lit(0)})
    got = {r.conv_id: (r.n_turns, r.copies, r.rendered) for r in chat.format_chats(df).collect()}
    assert got == plain(rows)


def test_random_logs_equal_plain_ones(spark):
    rng = random.Random(6)
    rows = []
    for c in range(60):
        base = random.Random(rng.randrange(6))
        rows += [(c, t, base.choice(["user", "assistant", None]), base.choice(["hi", "ho", "", None])) for t in range(rng.randrange(1, 7))]
    check(spark, rows + rng.sample(rows, 40))


def test_ties_nulls_negatives_and_long_ones(spark):
    rng = random.Random(7)
    rows = [(1, t, "user", f"t{t}") for t in range(1500)] + [(2, t, "user", f"t{t}") for t in range(1400)]
    rows += [(3, None, "b", "x"), (3, None, "a", "y"), (3, None, "a", "w"), (3, -700, "user", "neg"), (3, 0, "user", "zero"), (4, None, "a", "w"), (4, 3, "a", "y")]
    rows += [(5, 1, "b", "2"), (5, 1, "a", "1"), (5, 1, "b", "1"), (5, 2, "z", None), (6, 0, "a", "1"), (6, 1, "b", "1"), (6, 2, "b", "2"), (None, 1, "a", "b")]
    rows += [(7, 1 << 60, "u", "far"), (7, -(1 << 60), "u", "back"), (8, 0, "u", "long " * 60_000)]
    rng.shuffle(rows)
    check(spark, rows)


def test_no_turns(spark):
    assert chat.format_chats(spark.createDataFrame([], TURNS)).collect() == []


def test_one_hot_first_turn(spark):
    rows = [(c, 0, "system", "hello") for c in range(400)] + [(c, 1, "user", f"q{c % 150}") for c in range(400)] + [(c, 2, "assistant", "a") for c in range(0, 400, 2)]
    check(spark, rows)
