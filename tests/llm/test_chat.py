import random

from commitloom.llm import chat


def brute(rows):
    talks = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            talks.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    talks = {c: tuple(t[1:] for t in sorted(ts)) for c, ts in talks.items()}
    whole = {}
    for c, t in talks.items():
        whole[t] = min(c, whole.get(t, c))
    prefixes = {t[:k] for t in whole for k in range(1, len(t))}
    show = lambda t: "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in t)
    return sorted((c, len(t), show(t)) for t, c in whole.items() if t not in prefixes)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "conv_id long, turn long, role string, text string, n_turns string, d1 int").repartition(3)
    return sorted(tuple(r) for r in chat.format_chats(df).collect())


def test_snapshots_collapse(spark):
    r = random.Random(2)
    rows, conv = [], 0
    for _ in range(25):
        talk = [(r.choice(["user", "assistant"]), r.choice(["hi", "a", "b", "é"])) for _ in range(r.randint(1, 6))]
        for cut in r.sample(range(1, len(talk) + 1), r.randint(1, len(talk))):
            rows += [(conv, i, *t) for i, t in enumerate(talk[:cut])]
            conv += 1
    assert run(spark, rows) == brute(rows)


def test_cases(spark):
    rows = [
        (1, 0, "user", "x"), (2, 0, "user", "x"), (2, 1, "assistant", None), (3, 0, "user", "x"), (3, 1, "assistant", ""), (4, None, None, "first"), (4, 0, "user", "long " * 50_000),
        (5, 0, "user", "same"), (5, 0, "user", "same"), (6, 0, "user", "same"), (7, 1, "b", "t"), (7, 1, "a", "t"), (None, 0, "user", "lost"), (8, 0, "", ""),
    ]
    assert run(spark, rows) == brute(rows)
    assert [c for c, _, _ in run(spark, rows)] == [2, 4, 5, 7, 8]
    assert run(spark, []) == []


def test_order_and_border_of_fields_matter(spark):
    rows = [(1, 0, "ab", "c"), (2, 0, "a", "bc"), (2, 1, "x", "y"), (3, 0, "x", "y"), (3, 1, "a", "bc"), (3, 2, "q", "r")]
    assert run(spark, rows) == brute(rows) and len(run(spark, rows)) == 3
