from textkiln.constants import SEQ_LEN
from textkiln.plans import training


def test_corpus_plan_writes_shards_in_shuffled_order(spark, tmp_path, enc):
    texts = [("word " * (i * 53 % 1400)) + f"doc{i}" for i in range(40)] + [None, ""]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = str(tmp_path / "rows")
    training.write_corpus_rows(df, out, num_shards=3)
    back = spark.read.parquet(out).collect()
    assert sorted(r.doc_id for r in back) == list(range(40))
    assert {r.shard for r in back} <= {0, 1, 2}
    ranks = {r.doc_id: r.shuffle_rank for r in training.corpus_plan(df).collect()}
    assert sorted(ranks) == list(range(40)) and sorted(ranks.values()) == list(range(40))  # empty texts get no rank
    # the shuffle key orders rows exactly as the integer rank does
    keys = sorted((r.shuffle_key, r.doc_id) for r in back)
    assert [d for _, d in keys] == sorted([r.doc_id for r in back], key=lambda d: ranks[d])
    for r in back:
        assert len(r.input_ids) == SEQ_LEN and len(r.labels) == SEQ_LEN
        ids = enc.encode_ordinary(texts[r.doc_id])
        if len(ids) > SEQ_LEN:
            assert list(r.input_ids) == ids[r.crop_start : r.crop_start + SEQ_LEN]
        else:
            assert list(r.input_ids[: len(ids)]) == ids


def test_chat_plan_writes_rows(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {c}") for c in range(10) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = str(tmp_path / "chat")
    training.write_chat_rows(df, out)
    back = spark.read.parquet(out).collect()
    assert sorted(r.conv_id for r in back) == list(range(10)) and all(len(r.input_ids) == SEQ_LEN for r in back)
