
from pyspark.sql import functions as F

from textkiln.constants import EOT, IGNORE, SEQ_LEN
from textkiln.operators import sampling, tokens


def _rows(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    t = tokens.tokenize(df, tokenizer="hashed")
    return {r.doc_id: r for r in sampling.crop_or_pad(t).collect()}


def test_crop_and_pad_edges(spark):
    texts = [" a" * 1024, " a" * 1025, " a" * 10, None, " a" * 3000]
    rows = _rows(spark, texts)
    assert 3 not in rows  # null text dropped
    exact = rows[0]
    assert exact.crop_start == 0 and list(exact.labels) == list(exact.input_ids) and EOT not in exact.input_ids
    assert rows[1].crop_start in (0, 1)
    short = rows[2]
    assert short.input_ids[-1] == EOT and short.labels[-1] == IGNORE and list(short.labels[:10]) == list(short.input_ids[:10])
    for r in rows.values():
        assert len(r.input_ids) == SEQ_LEN and len(r.labels) == SEQ_LEN
        assert all(lab in (i, IGNORE) for i, lab in zip(r.input_ids, r.labels))
    long = rows[4]
    assert 0 <= long.crop_start <= 3000 - SEQ_LEN and list(long.labels) == list(long.input_ids)


def test_shards_partition_ids_and_shuffle_is_permutation(spark):
    df = spark.range(0, 5000).withColumnRenamed("id", "doc_id")
    sh = sampling.shard(df, 3).groupBy("shard").count().collect()
    assert sum(r["count"] for r in sh) == 5000 and {r.shard for r in sh} <= {0, 1, 2}
    ranks = [r.shuffle_rank for r in sampling.seeded_shuffle(df).collect()]
    assert sorted(ranks) == list(range(5000))


def test_shuffle_independent_of_partitioning(spark):
    df = spark.range(0, 3000).withColumnRenamed("id", "doc_id")
    a = {r.doc_id: r.shuffle_rank for r in sampling.seeded_shuffle(df.repartition(1)).collect()}
    b = {r.doc_id: r.shuffle_rank for r in sampling.seeded_shuffle(df.repartition(37)).collect()}
    assert a == b


def test_batch_plan_steps(spark):
    df = spark.range(0, 300).withColumnRenamed("id", "doc_id")
    plan = sampling.batch_plan(sampling.seeded_shuffle(df), batch_size=2, grad_accum=64, max_steps=2).collect()
    assert len(plan) == 256 and {r.global_step for r in plan} == {1, 2} and all(r.step_complete for r in plan)
    plan3 = sampling.batch_plan(sampling.seeded_shuffle(df), batch_size=2, grad_accum=64, max_steps=5).collect()
    last = [r for r in plan3 if r.global_step == 3]
    assert len(last) == 44 and not any(r.step_complete for r in last)


def test_tail_context(spark):
    df = spark.createDataFrame([(list(range(2000)),), ([1, 2],)], "t array<int>")
    out = df.select(sampling.tail_context("t").alias("c")).collect()
    assert list(out[0].c) == list(range(976, 2000)) and list(out[1].c) == [1, 2]


def test_multi_epoch_plan_continues_micro_steps(spark):
    df = spark.range(0, 7).withColumnRenamed("id", "doc_id")
    rows = sampling.multi_epoch_plan(df, 2, batch_size=2, grad_accum=3).collect()
    assert len(rows) == 14
    per_epoch = 4  # ceil(7 / 2): the last batch of an epoch holds one row
    for r in rows:
        assert r.micro_step == r.epoch * per_epoch + r.shuffle_rank // 2
        assert r.global_step == r.micro_step // 3 + 1
    assert {r.planned_steps for r in rows} == {(per_epoch // 3) * 2}
    assert max(r.global_step for r in rows) == 3  # more steps than planned (2)
    e0 = {r.doc_id: r.shuffle_rank for r in rows if r.epoch == 0}
    e1 = {r.doc_id: r.shuffle_rank for r in rows if r.epoch == 1}
    assert sorted(e0.values()) == sorted(e1.values()) == list(range(7)) and e0 != e1


def test_in_shuffled_order_sorts_each_partition(spark):
    df = sampling.seeded_shuffle(spark.range(0, 500).withColumnRenamed("id", "doc_id"))
    parts = sampling.in_shuffled_order(df, num_partitions=5).rdd.glom().map(lambda rows: [r.shuffle_rank for r in rows]).collect()
    flat = [x for p in parts for x in p]
    assert flat == list(range(500))


def test_token_counts_and_packing_report(spark):
    from textkiln.operators import tokens as tk

    df = spark.createDataFrame(
        [(1, "en", "a", [1] * 10), (2, "en", "a", [2] * 2000), (3, "fr", "b", [3] * 1024)],
        "doc_id long, lang string, source string, tokens array<int>",
    )
    counts = {(r.lang, r.source): (r.n_docs, r.n_tokens, r.max_tokens) for r in tk.token_counts(df).collect()}
    assert counts == {("en", "a"): (2, 2010, 2000), ("fr", "b"): (1, 1024, 1024)}
    rows = sampling.crop_or_pad(df).withColumn("n_tokens", F.size("tokens").cast("bigint"))
    rep = sampling.packing_report(rows, batch_size=2, grad_accum=1).first()
    assert (rep.n_rows, rep.n_tokens, rep.n_pad, rep.n_cropped) == (3, 10 + 1024 + 1024, 1014, 1)
    assert rep.n_targets == 9 + 1023 + 1023 and rep.token_budget == 3 * 1024
    assert (rep.micro_steps, rep.global_steps) == (2, 2)


def test_all_rows_cover_every_token(spark):
    df = spark.createDataFrame([(1, list(range(10))), (2, list(range(8))), (3, [])], "doc_id long, tokens array<int>")
    rows = sorted(sampling.all_rows(df, seq_len=4).collect(), key=lambda r: (r.doc_id, r.row_no))
    assert [(r.doc_id, r.row_no) for r in rows] == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1)]
    for d in (1, 2):
        assert [x for r in rows if r.doc_id == d for x in r.labels if x != -100] == list(range(10 if d == 1 else 8))
    assert all(len(r.input_ids) == len(r.labels) == 4 for r in rows)


def test_a_plan_without_a_last_step_covers_every_row(spark):
    ranked = sampling.seeded_shuffle(spark.range(0, 1000).withColumnRenamed("id", "doc_id"))
    plan = sampling.batch_plan(ranked, batch_size=1, grad_accum=1).collect()
    assert len(plan) == 1000 and max(r.global_step for r in plan) == 1000 and all(r.step_complete for r in plan)


def test_joined_corpus_with_hashed_ids(spark):
    import hashlib

    from textkiln.sources.corpus import concat_prefix

    rows = [(hashlib.md5(str(i).encode()).hexdigest(), "t" * (i % 7) + str(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "item_id string, text string").repartition(6)
    whole = "\n\n".join(t for _, t in sorted(rows))
    for limit in (None, 500):
        segs = sorted(concat_prefix(df, limit=limit).collect(), key=lambda r: r.seg_id)
        assert "".join(r.segment for r in segs) == whole[:limit]
