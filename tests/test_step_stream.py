from pyspark.sql import functions as F

from textkiln.operators import sampling
from textkiln.streaming import corpus_stream, step_stream

SCHEMA = "doc_id long, key string"


def make(spark, n, path):
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.md5(F.col("id").cast("string")).alias("key"))
    return df, corpus_stream.corpus_stream(spark, corpus_stream.feed(df, slices=5, order=["key"]), schema=SCHEMA)


def plan_of(rows):
    return sorted((r.rank, r.doc_id, r.micro_step, r.global_step) for r in rows)


def wanted(df, **how):
    ranks = {r.doc_id: i for i, r in enumerate(sorted(df.collect(), key=lambda r: r.key))}
    ranked = df.sparkSession.createDataFrame([(d, i) for d, i in ranks.items()], "doc_id long, shuffle_rank long")
    return sorted((r.shuffle_rank, r.doc_id, r.micro_step, r.global_step) for r in sampling.batch_plan(ranked, batch_size=2, grad_accum=4, **how).collect())


def test_union_equals_the_batch_plan(spark, tmp_path):
    df, stream = make(spark, 103, tmp_path)
    out = step_stream.run_steps(stream, str(tmp_path / "run"), ["key"], batch_size=2, grad_accum=4)
    assert plan_of(out.collect()) == wanted(df)


def test_stops_after_the_last_step(spark, tmp_path):
    df, stream = make(spark, 103, tmp_path)
    base = str(tmp_path / "run")
    out = step_stream.run_steps(stream, base, ["key"], batch_size=2, grad_accum=4, max_steps=4)
    want = wanted(df, max_steps=4)
    assert plan_of(out.collect()) == want and len(want) == 32
    # 103 rows in 5 files of 21: the second micro-batch completes step 4, later ones are not planned
    assert spark.read.option("recursiveFileLookup", "true").parquet(base + "/ledger").agg(F.sum("n_rows")).first()[0] == 42
    assert plan_of(step_stream.run_steps(stream, base, ["key"], batch_size=2, grad_accum=4, max_steps=4).collect()) == want


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    base = str(tmp_path)
    parts = [spark.createDataFrame([(i, str(i)) for i in r], SCHEMA) for r in (range(0, 7), range(10, 15), range(20, 23))]
    for k in (0, 1, 1, 0, 2, 2):
        step_stream.count_steps(parts[k], k, base, ["doc_id"], batch_size=2, grad_accum=2)
    got = sorted((r.rank, r.doc_id) for r in spark.read.option("recursiveFileLookup", "true").parquet(base + "/rows").collect())
    assert got == list(enumerate([*range(0, 7), *range(10, 15), *range(20, 23)]))


def test_empty_batches_and_goes_on(spark, tmp_path):
    base = str(tmp_path)
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(5, "a"), (5, "a"), (None, None)], SCHEMA)
    assert not step_stream.count_steps(none, 0, base, ["doc_id"], max_steps=1)
    assert not step_stream.count_steps(some, 1, base, ["doc_id"], max_steps=1)
    assert step_stream.count_steps(some, 2, base, ["doc_id"], batch_size=2, grad_accum=2, max_steps=1)
    rows = spark.read.option("recursiveFileLookup", "true").parquet(base + "/rows").collect()
    assert sorted(r["rank"] for r in rows) == [0, 1, 2, 3]
