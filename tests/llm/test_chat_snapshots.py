import random

from textkiln.llm import chat_snapshots as C


def by_hand(turns):
    """Kept conversations: conv_id -> list of (role, text)."""
    import hashlib

    convs = {}
    for c, t, r, x in turns:
        convs.setdefault(c, []).append((t is not None, t or 0, hashlib.md5(f"{r or ''}\x1f{x or ''}".encode()).hexdigest(), r or "", x or ""))
    seqs = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, s in sorted(seqs.items(), key=lambda kv: (kv[0] is None, kv[0] or 0)):
        if any(len(o) > len(s) and o[: len(s)] == s for o in seqs.values()) or s in out.values():
            continue
        out[c] = s
    return out


def run(spark, turns):
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS pos", "'q' AS rendered", "2 AS n")
    got = {}
    for r in C.collapse(df).collect():
        got.setdefault(r.conv_id, []).append((r.pos, r.role, r.text, r.n_turns, r.rendered))
    for rows in got.values():
        assert [p for p, *_ in sorted(rows)] == list(range(1, len(rows) + 1))
        assert all(n == len(rows) and x == f"<|im_start|>{r}\n{t}<|im_end|>\n" for _, r, t, n, x in rows)
    return {c: [(r, t) for _, r, t, *_ in sorted(rows)] for c, rows in got.items()}


def test_snapshots_equal_brute_force(spark):
    rnd = random.Random(7)
    turns = []
    for c in range(60):
        for t in range(rnd.randrange(1, 6)):
            turns.append((c, t, ["user", "assistant"][t % 2], rnd.choice("ab")))
    assert run(spark, turns) == by_hand(turns)


def test_cumulative_log_keeps_the_last_state(spark):
    chat = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "done")]
    turns = [(k, t, r, x) for k in range(1, 5) for t, (r, x) in enumerate(chat[:k])]
    assert run(spark, turns) == {4: chat}


def test_odd_rows(spark):
    turns = [
        (1, 0, "user", None), (1, 1, None, "x"), (2, 0, "user", ""), (2, 1, "", "x"), (2, 2, "user", "y"),  # 1 is a prefix of 2
        (3, None, "user", "a"), (3, 0, "user", "b"), (4, 5, "user", "a"), (4, 5, "user", "b"),  # a tie in turn; null comes first
        (None, 0, "user", "p"), (None, 1, "user", "q"), (5, 0, "user", "p"), (5, 1, "user", "q"),
        (6, 0, "user", "r"), (6, 0, "user", "r"),  # a repeated row
        (7, 0, "user", "long " * 50_000),
    ]
    got = run(spark, turns)
    assert got == by_hand(turns) and 1 not in got and None not in got and len(got[6]) == 2
    assert run(spark, []) == {}


def test_a_conversation_of_thousands_of_turns(spark):
    turns = [(1, t, "user", str(t)) for t in range(6000)] + [(2, t, "user", str(t)) for t in range(5000)] + [(3, 0, "user", "0")] + [(4, 0, "user", "1")]
    got = run(spark, turns)
    assert sorted(got) == [1, 4] and len(got[1]) == 6000
