from pyspark.sql import functions as F

from textkiln.constants import EOT
from textkiln.operators import tokens


def test_spot_check_ids(enc):
    assert enc.encode_ordinary("hello world") == [31373, 995]


def test_udf_equals_library_and_roundtrip(spark, enc):
    texts = ["hello world", "  leading and trailing  ", "<|endoftext|> is ordinary text", "naïve café 123", "a\n\nb"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: list(r.tokens) for r in tokens.tokenize(df, tokenizer="bpe").collect()}
    assert got == {i: enc.encode_ordinary(t) for i, t in enumerate(texts)}
    rt = tokens.tokenize(df, tokenizer="bpe").select("doc_id", "text", tokens.decode(F.col("tokens")).alias("back"))
    assert all(r.back == r.text for r in rt.collect())


def test_decode_renders_eot(spark):
    df = spark.createDataFrame([([31373, EOT, 995],)], "ids array<int>")
    assert df.select(tokens.decode(F.col("ids")).alias("t")).first().t == "hello<|endoftext|> world"


def test_drop_empty_and_null(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x")], "doc_id long, text string")
    for tk in ("bpe", "hashed"):
        out = tokens.drop_empty(tokens.tokenize(df, tokenizer=tk))
        assert [r.doc_id for r in out.collect()] == [3]


def test_hashed_ids_are_in_vocab(spark):
    df = spark.createDataFrame([(1, "The cat's 42 hats!\n\n  ok")], "doc_id long, text string")
    ids = tokens.tokenize(df, tokenizer="hashed").first().tokens
    # The, " cat", "'s", " 42", " hats", "!", "\n\n  ", "ok": without the look-ahead, \s+ takes the whole run
    assert len(ids) == 8 and all(0 <= i < EOT for i in ids)


def test_the_native_tokenizer_is_evaluated_once(spark):
    df = spark.createDataFrame([(1, "one two"), (2, "")], "doc_id long, text string")
    kept = tokens.drop_empty(tokens.tokenize(df, tokenizer="hashed")).select("doc_id", F.size("tokens"))
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert [r.doc_id for r in kept.collect()] == [1]


def test_bpe_batches_are_bounded_in_bytes(enc):
    import pyarrow as pa

    texts = ["word " * 100_000, "a b", None, "word " * 150_000, "x", "word " * 200_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["doc_id", "text"])
    made = list(tokens._encode_batches("text", "tokens")([batch]))
    assert len(made) == 3 and all(b.schema.field("tokens").type == pa.list_(pa.int32()) for b in made)
    got = {i: t for b in made for i, t in zip(b["doc_id"].to_pylist(), b["tokens"].to_pylist(), strict=True)}
    assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(texts)}
