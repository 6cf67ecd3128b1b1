from textkiln.constants import EOT, IGNORE, SEQ_LEN
from textkiln.operators.chat import chat_training_rows


def _expected(enc, turns):
    ids, labels = [], []
    for _, role, text in sorted(turns):
        if role == "user":
            t = enc.encode_ordinary(f"User: {text}\nAssistant: ")
            ids += t
            labels += [IGNORE] * len(t)
        elif role == "assistant":
            t = enc.encode_ordinary(text) + [EOT]
            ids += t
            labels += t
    total = len(ids)
    ids, labels = ids[:SEQ_LEN], labels[:SEQ_LEN]
    pad = SEQ_LEN - len(ids)
    return ids + [EOT] * pad, labels + [IGNORE] * pad, total


def test_chat_rows_match_turn_by_turn_encoding(spark, enc):
    convs = {
        1: [(0, "system", "be nice"), (1, "user", "Hi there"), (2, "assistant", "Hello!")],
        2: [(0, "user", "one"), (1, "user", "two"), (2, "assistant", "three")],
        3: [(0, "user", "q"), (1, "assistant", "a"), (2, "user", "dangling")],
        4: [(0, "user", " word" * 1100), (1, "assistant", "late")],
        5: [(0, "system", "only system")],
    }
    rows = [(c, t, r, x) for c, ts in convs.items() for t, r, x in ts]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_training_rows(df, tokenizer="bpe").collect()}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        ids, labels, total = _expected(enc, turns)
        assert list(got[c].input_ids) == ids and list(got[c].labels) == labels
        assert got[c].total_tokens == total and got[c].truncated == (total > SEQ_LEN)
    assert got[4].zero_target and got[4].truncated
    assert got[5].zero_target and set(got[5].input_ids) == {EOT}
    seg = enc.encode_ordinary("\nAssistant: ")
    assert list(got[2].input_ids).count(seg[-1]) >= 2  # the suffix appears after both user turns
    tail = list(got[3].labels)
    n3 = got[3].n_tokens
    assert all(x == IGNORE for x in tail[n3 - 3 : n3])  # conversation ending on a user turn


def test_a_conversation_of_thousands_of_empty_turns(spark):
    rows = [(1, t, "system", "be nice") for t in range(5000)] + [(1, 5000, "user", "hi"), (1, 5001, "assistant", "hello"), (None, 0, "user", "no id")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_training_rows(df, tokenizer="hashed").collect()}
    alone = {r.conv_id: r for r in chat_training_rows(df.where("role <> 'system'"), tokenizer="hashed").collect()}
    assert set(got) == {1, None}
    assert got[1].input_ids == alone[1].input_ids and got[1].n_targets == alone[1].n_targets > 0
