"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Queries that must be checked against DuckDB tokenize with the native
``hashed`` tokenizer; ``*_bpe`` variants use the real byte-level BPE and are
checked by unit tests against the tokenizer library itself. Wide array
columns are reported as md5 fingerprints plus scalar statistics.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textkiln.constants import MAX_NEW_CHAT, SEED, SEQ_LEN, STREAM_STEPS, USER_PREFIX, USER_SUFFIX, VOCAB_SIZE
from textkiln.functions.arrays import array_md5, count_valid
from textkiln.functions.gates import clamp, sigmoid, softplus
from textkiln.functions.hashing import seeded_hash_hex, seeded_u32
from textkiln.functions.text import pretokenize
from textkiln.functions.vectors import dot, l2_norm, rms_norm
from textkiln.operators import chat, evaluation, generation, sampling, sequence, tokens, vectors
from textkiln.plans import heldout, training
from textkiln.session import checkpoint_dir, materialize
from textkiln.sources import sinks
from textkiln.sources.corpus import chat_scan, concat_prefix, corpus_scan, nest_conversations, table_path, unnest_conversations
from textkiln.streaming import corpus_stream, event_time, liquid_state, step_stream


def documents(spark: SparkSession, sf: str, cols=("doc_id", "text", "lang", "source")) -> DataFrame:
    return corpus_scan(spark, table_path(sf, "documents"), cols)


def doc_tokens(spark: SparkSession, sf: str, tokenizer: str = "hashed") -> DataFrame:
    """Tokenized, non-empty documents. The hashed tokenizer yields at least one
    piece for any non-empty text, so the native text filter inside ``tokenize``
    already drops empty rows; a filter on the token column would be rewritten by
    Catalyst into a second evaluation of the tokenizer expression."""
    t = tokens.tokenize(documents(spark, sf), tokenizer=tokenizer)
    return tokens.drop_empty(t) if tokenizer == "bpe" else t


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    return chat_scan(spark, table_path(sf, "conversations"))


def _chat_report(rows: DataFrame) -> DataFrame:
    return rows.select(
        "conv_id",
        "n_tokens",
        "total_tokens",
        "n_targets",
        "truncated",
        "zero_target",
        array_md5(F.col("input_ids")).alias("ids_md5"),
        array_md5(F.col("labels")).alias("labels_md5"),
    )


def q_chat_training_rows(spark, sf):
    return _chat_report(chat.chat_training_rows(conversations(spark, sf), tokenizer="hashed"))


def q_chat_training_rows_bpe(spark, sf):
    return _chat_report(chat.chat_training_rows(conversations(spark, sf), tokenizer="bpe"))


def q_corpus_scan(spark, sf):
    d = documents(spark, sf)
    return d.select("doc_id", "lang", "source", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


def q_chat_scan(spark, sf):
    n = nest_conversations(conversations(spark, sf))
    return n.select(
        "conv_id",
        F.size("messages").cast("bigint").alias("n_messages"),
        F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"),
        F.md5(F.array_join(F.transform("messages", lambda m: m["content"]), "\u0001")).alias("content_md5"),
    )


def q_chat_roundtrip(spark, sf):
    """Nested -> long: each message at its position in the conversation."""
    return unnest_conversations(nest_conversations(conversations(spark, sf))).select("conv_id", "turn", "role", "text")


def q_chat_template(spark, sf):
    t = chat.chat_template(chat.role_route(conversations(spark, sf)))
    return t.select("conv_id", "turn", "role", "segment")


def q_pretokenize(spark, sf):
    d = documents(spark, sf).withColumn("pieces", pretokenize(F.col("text")))
    return d.select(
        "doc_id", F.size("pieces").cast("bigint").alias("n_pieces"), F.md5(F.array_join("pieces", "\u0001")).alias("pieces_md5")
    )


def q_drop_empty(spark, sf):
    return tokens.drop_empty(doc_tokens(spark, sf)).select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"))


def q_token_counts(spark, sf):
    return tokens.token_counts(doc_tokens(spark, sf))


def q_seeded_shuffle(spark, sf):
    return sampling.seeded_shuffle(documents(spark, sf, ("doc_id",))).select("doc_id", "shuffle_rank")


def q_shard(spark, sf):
    return sampling.shard(documents(spark, sf, ("doc_id",)), 2).select("doc_id", "shard")


def corpus_rows(spark, sf, tokenizer="hashed") -> DataFrame:
    return sampling.crop_or_pad(doc_tokens(spark, sf, tokenizer)).withColumn(
        "n_tokens", F.size("tokens").cast("bigint")
    )


def q_corpus_training_rows(spark, sf):
    r = corpus_rows(spark, sf)
    return r.select(
        "doc_id",
        "n_tokens",
        F.col("crop_start").cast("bigint").alias("crop_start"),
        count_valid(F.col("labels")).cast("bigint").alias("n_targets"),
        F.size("input_ids").cast("bigint").alias("row_len"),
        array_md5(F.col("input_ids")).alias("ids_md5"),
        array_md5(F.col("labels")).alias("labels_md5"),
    )


def q_batch_plan(spark, sf):
    plan = training.corpus_plan(documents(spark, sf, ("doc_id", "text")))
    return plan.select("doc_id", "shuffle_rank", "micro_step", "global_step", "step_complete")


def blanked(spark, sf) -> DataFrame:
    """Documents with every fifth text empty: such rows get no place in a plan."""
    d = documents(spark, sf, ("doc_id", "text"))
    return d.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.col("text")))


def q_batch_plan_with_empty(spark, sf):
    plan = training.corpus_plan(blanked(spark, sf))
    return plan.select("doc_id", "shuffle_rank", "micro_step", "global_step", "step_complete")


def q_packing_report(spark, sf):
    return sampling.packing_report(corpus_rows(spark, sf))


def q_head_truncate(spark, sf):
    d = doc_tokens(spark, sf).withColumn("head", sampling.head_truncate("tokens"))
    return d.select("doc_id", F.size("head").cast("bigint").alias("n_head"), array_md5(F.col("head")).alias("head_md5"))


def q_tail_context(spark, sf):
    d = doc_tokens(spark, sf).withColumn("ctx", sampling.tail_context("tokens", SEQ_LEN))
    return d.select("doc_id", F.size("ctx").cast("bigint").alias("n_ctx"), array_md5(F.col("ctx")).alias("ctx_md5"))


# --------------------------------------------------------------------------- evaluation


def fit_model(spark, sf, tokenizer="hashed") -> evaluation.NGramModel:
    return evaluation.ngram_fit(doc_tokens(spark, sf, tokenizer))


def q_next_token_pairs(spark, sf):
    p = evaluation.next_token_pairs(doc_tokens(spark, sf), ["doc_id"])
    return p.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.sum(F.col("pos") * (F.col("ctx") + 1) + F.col("next")).cast("bigint").alias("checksum"),
    )


def q_ngram_fit(spark, sf):
    m = fit_model(spark, sf)
    uni = m.per_token(m.unigram.select(F.col("token").alias("next"), F.col("count").alias("c_uni")))
    b = m.bigram.join(m.per_token(m.context), "ctx").join(uni, "next", "left")
    p = F.lit(0.9) * F.col("count") / F.col("total") + F.lit(0.1) * m.unigram_prob(F.col("c_uni"))
    return b.groupBy("ctx").agg(
        F.first("total").cast("bigint").alias("n_ctx"),
        F.count(F.lit(1)).alias("n_next"),
        F.round(F.max(p), 6).alias("p_top"),
    )


def q_next_token_nll(spark, sf):
    m = fit_model(spark, sf)
    pieces = heldout.heldout_pieces(heldout.heldout_texts(spark, sf), tokenizer="hashed")
    s = evaluation.score_pairs(heldout.heldout_pairs(pieces), m, "bigram")
    return s.select("pos", "ctx", "next", F.round("nll", 6).alias("nll"))


def all_corpus_rows(spark, sf) -> DataFrame:
    """Training rows that cover every token of every document."""
    rows = sampling.all_rows(doc_tokens(spark, sf))
    return rows.select(F.concat_ws("-", "doc_id", "row_no").alias("row_id"), "doc_id", "row_no", "input_ids", "labels")


def q_masked_cross_entropy(spark, sf):
    m = fit_model(spark, sf)
    # read for the pairs and for the keys: written once, so the tokenizer runs once
    rows = materialize(all_corpus_rows(spark, sf).drop("row_id"), "loss-rows")
    ce = evaluation.masked_cross_entropy(rows, m, ["doc_id", "row_no"])
    return ce.select("doc_id", "row_no", "n_valid", F.round("mean_nll", 6).alias("mean_nll"))


def q_chat_masked_cross_entropy(spark, sf):
    """Loss over the assistant's tokens of every conversation's training row."""
    m = fit_model(spark, sf)
    rows = chat.chat_training_rows(conversations(spark, sf), tokenizer="hashed")
    ce = evaluation.masked_cross_entropy(rows, m, ["conv_id"])
    return ce.select("conv_id", "n_valid", F.round("mean_nll", 6).alias("mean_nll"))


#: Steps of the smoothing window of the loss curve query.
CURVE_WINDOW = 3


def q_loss_curve(spark, sf):
    """Two epochs of chat rows: losses, accumulation over 16 micro-steps, smoothed curve."""
    from textkiln.constants import CHAT_GRAD_ACCUM

    m = fit_model(spark, sf)
    rows = materialize(chat.chat_training_rows(conversations(spark, sf), tokenizer="hashed").select("conv_id", "input_ids", "labels"), "curve-rows")
    ce = evaluation.masked_cross_entropy(rows, m, ["conv_id"])
    plan = sampling.multi_epoch_plan(rows, 2, id_col="conv_id", grad_accum=CHAT_GRAD_ACCUM)
    steps = evaluation.accumulate_steps(ce, plan, key="conv_id").withColumn("run", F.lit("chat"))
    curve = sequence.trailing_mean(steps.select("run", "global_step", "logged_loss"), "run", ["global_step"], "logged_loss", window=CURVE_WINDOW, out="smoothed")
    return curve.select("global_step", F.round("logged_loss", 6).alias("logged_loss"), F.round("smoothed", 6).alias("smoothed"))


def _doc_lengths(spark, sf):
    return doc_tokens(spark, sf).select("doc_id", "tokens", F.size("tokens").cast("bigint").alias("L"))


def q_sliding_windows(spark, sf):
    w = evaluation.sliding_windows(_doc_lengths(spark, sf), ["doc_id"])
    return w.select("doc_id", "i", "begin_loc", "end_loc", "trg_len")


def q_window_membership(spark, sf):
    d = _doc_lengths(spark, sf).select("doc_id", "L", F.posexplode("tokens").alias("pos", "tok"))
    m = evaluation.window_membership(d, ["doc_id"])
    return m.groupBy("doc_id", "i").agg(
        F.sum((F.col("role") == "target").cast("int")).cast("bigint").alias("n_target"),
        F.sum((F.col("role") == "context").cast("int")).cast("bigint").alias("n_context"),
    )


def q_sliding_perplexity(spark, sf):
    m = fit_model(spark, sf)
    items = tokens.tokenize(heldout.heldout_texts(spark, sf), tokenizer="hashed")
    pairs = evaluation.score_pairs(evaluation.next_token_pairs(items, ["item_id"]), m, "bigram")
    lengths = items.select("item_id", F.size("tokens").cast("bigint").alias("L"))
    ppl = evaluation.sliding_perplexity(pairs, lengths, ["item_id"])
    return ppl.select("item_id", "n_tokens", "n_windows", "n_targets", F.round("ppl", 6).alias("ppl"))


def model_results(spark, sf, tokenizer="hashed") -> DataFrame:
    """Unigram vs bigram on the joined held-out prefix: both scored in one pass,
    unpivoted to ``(model, seq, pos, nll)``, one grouped perplexity per model."""
    m = fit_model(spark, sf, tokenizer)
    pieces = heldout.heldout_pieces(heldout.heldout_texts(spark, sf), tokenizer=tokenizer)
    scored = evaluation.score_models(heldout.heldout_pairs(pieces), m, ["unigram", "bigram"])
    long = scored.select("seq", "pos", F.expr("stack(2, 'unigram', nll_unigram, 'bigram', nll_bigram) AS (model, nll)"))
    lengths = heldout.heldout_length(pieces)
    lengths = lengths.select(F.explode(F.array(F.lit("unigram"), F.lit("bigram"))).alias("model"), "seq", "L")
    ppl = materialize(evaluation.sliding_perplexity(long, lengths, ["model", "seq"]), "model-results")
    results = [
        ppl.where(F.col("model") == name).select(
            "model",
            F.round("ppl", 6).alias("ppl"),
            F.format_string("%.2f", "ppl").alias("ppl_text"),  # the printed report's 2 decimals
            F.col("n_tokens").alias("eval_tokens"),
            "n_windows",
            F.lit(entries).cast("bigint").alias("model_entries"),
        )
        for name, entries in (("unigram", m.vocab - 1), ("bigram", m.n_bigrams))
    ]
    return evaluation.model_comparison(results)


def q_model_metrics(spark, sf):
    """The comparison as a report: a row per metric, a column per model."""
    r = evaluation.metric_pivot(model_results(spark, sf), ["ppl", "eval_tokens", "n_windows", "model_entries"])
    return r.select("metric", "unigram", "bigram")


def q_model_comparison(spark, sf):
    return model_results(spark, sf)


def q_model_comparison_bpe(spark, sf):
    return model_results(spark, sf, "bpe")


def q_corpus_concat_prefix(spark, sf):
    s = concat_prefix(documents(spark, sf, ("doc_id", "text")), "doc_id", "text")
    return s.select("seg_id", "seg_start", F.length("segment").cast("bigint").alias("n_chars"), F.md5("segment").alias("segment_md5"))


def q_heldout_tokens(spark, sf):
    p = heldout.heldout_pieces(heldout.heldout_texts(spark, sf), tokenizer="hashed")
    t = p.select("tok_offset", F.posexplode("tokens").alias("i", "token"))
    return t.select((F.col("tok_offset") + F.col("i")).cast("bigint").alias("pos"), "token")


def q_accumulate_steps(spark, sf):
    """Losses of the rows that cover every token, in shuffled order."""
    m = fit_model(spark, sf)
    rows = materialize(all_corpus_rows(spark, sf), "step-rows")
    ce = evaluation.masked_cross_entropy(rows, m, ["row_id"])
    plan = sampling.batch_plan(sampling.seeded_shuffle(rows.select("row_id"), id_col="row_id"))
    st = evaluation.accumulate_steps(ce, plan, key="row_id")
    return st.select("global_step", "n_micro", F.round("mean_loss", 6).alias("mean_loss"), F.round("logged_loss", 6).alias("logged_loss"))


# --------------------------------------------------------------------------- sequences

EVENT_ORDER = ["ts", "event_id"]


def events(spark, sf) -> DataFrame:
    return spark.read.parquet(table_path(sf, "events")).select("event_id", "ts", "user_id", "event_type", "value")


def recurrence_inputs():
    """Fixture gates on ``events``: errors reset the state (a = 0), large values keep
    it (a = 1). Divisors with non-terminating decimals keep rounded results away
    from exact decimal ties, where engines may round either way."""
    a = F.when(F.col("event_type") == "error", F.lit(0.0)).otherwise(F.least(F.col("value") / 300.0, F.lit(1.0)))
    return a, F.col("value") / 7.0


def q_linear_recurrence(spark, sf):
    a, b = recurrence_inputs()
    r = sequence.linear_recurrence(events(spark, sf), "user_id", EVENT_ORDER, a, b, h0=1.0, carry=[])
    return r.select("user_id", "event_id", F.round("h", 6).alias("h"))


def liquid(spark, sf) -> DataFrame:
    v = F.col("value")
    return sequence.liquid_filter(events(spark, sf), "user_id", EVENT_ORDER, v / 50.0, (v - 50.0) / 50.0, carry=[])


def q_liquid_filter(spark, sf):
    return liquid(spark, sf).select("user_id", "event_id", F.round("h", 6).alias("h"))


def q_final_state(spark, sf):
    f = sequence.final_state(liquid(spark, sf), "user_id", EVENT_ORDER)
    return f.select("user_id", "n_rows", F.round("h_final", 6).alias("h_final"))


def q_trailing_mean(spark, sf):
    t = sequence.trailing_mean(events(spark, sf), "user_id", EVENT_ORDER, "value")
    return t.select("user_id", "event_id", F.round("trailing_mean", 6).alias("trailing_mean"))


def q_causal_softmax_mean(spark, sf):
    e = events(spark, sf).select("user_id", "ts", "event_id", "value")
    c = sequence.causal_softmax_mean(e, "user_id", EVENT_ORDER, F.col("value") / 100.0, F.col("value"))
    return c.select("user_id", "event_id", F.round("attn", 6).alias("attn"))


def q_causal_softmax_mean_large_scores(spark, sf):
    """Scores of hundreds and thousands, whose exponentials overflow."""
    e = events(spark, sf).select("user_id", "ts", "event_id", "value")
    c = sequence.causal_softmax_mean(e, "user_id", EVENT_ORDER, F.col("value") * 10.0, F.col("value"))
    return c.select("user_id", "event_id", F.round("attn", 6).alias("attn"))


def q_history_attention(spark, sf):
    v = F.col("value")
    h = sequence.history_attention(events(spark, sf), "user_id", EVENT_ORDER, v / 100.0, v / 100.0, v, span=SEQ_LEN)
    return h.select("user_id", "event_id", "pos", F.round("attn", 6).alias("attn"))


def q_gate_functions(spark, sf):
    v = F.col("value")
    return events(spark, sf).select(
        "event_id",
        F.round(softplus(v / 50.0), 6).alias("softplus"),
        F.round(clamp(v / 100.0), 6).alias("clamp"),
        F.round(F.tanh((v - 50.0) / 50.0), 6).alias("tanh"),
        F.round(sigmoid((v - 50.0) / 50.0), 6).alias("sigmoid"),
    )


# --------------------------------------------------------------------------- vectors & generation

def embeddings(spark, sf) -> DataFrame:
    return spark.read.parquet(table_path(sf, "embeddings")).select("vec_id", "embedding")


def q_embedding_lookup(spark, sf):
    """Sum of the vectors of every document's tokens: tokens are counted per document
    first, so each distinct token meets its whole vector once. Texts are gathered by
    document before; counts and sums then stay in their partition."""
    d = tokens.tokenize(documents(spark, sf, ("doc_id", "text")).repartition("doc_id"), tokenizer="hashed")
    t = d.select("doc_id", F.explode("tokens").alias("token")).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))
    g = vectors.hashed_lookup(t, "token", embeddings(spark, sf), ids_below=VOCAB_SIZE)
    sums = [F.sum(F.col("n") * F.element_at("embedding", i + 1)).alias(f"s{i}") for i in range(64)]
    whole = g.groupBy("doc_id").agg(F.sum("n").cast("bigint").alias("n_tokens"), *sums)
    total = F.array(*[F.col(f"s{i}") for i in range(64)])
    return whole.select(
        "doc_id",
        "n_tokens",
        F.round("s0", 6).alias("sum_first"),
        F.round("s63", 6).alias("sum_last"),
        F.round(F.aggregate(total, F.lit(0.0), lambda a, x: a + x), 5).alias("sum_all"),
    )


def q_rms_norm(spark, sf):
    e = embeddings(spark, sf).withColumn("r", rms_norm(F.col("embedding")))
    return e.select(
        "vec_id",
        F.round(F.aggregate("r", F.lit(0.0), lambda a, x: a + x), 6).alias("rms_sum"),
        F.round(l2_norm(F.col("r")), 6).alias("rms_l2"),
    )


def q_dot(spark, sf):
    e = embeddings(spark, sf)
    nb = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next_embedding"))
    return e.join(nb, "vec_id").select("vec_id", F.round(dot(F.col("embedding"), F.col("next_embedding")), 6).alias("dot"))


def q_mips_topk(spark, sf):
    """Every vector whose id is divisible by 20 as a query, against all vectors."""
    e = embeddings(spark, sf)
    top = vectors.mips_topk(
        e.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_vec")),
        e.select(F.col("vec_id").alias("cand_id"), F.col("embedding").alias("c_vec")),
        k=5,
    )
    return top.select("query_id", F.col("rank").cast("bigint").alias("rank"), "cand_id", F.round("score", 6).alias("score"))


def q_greedy_next(spark, sf):
    g = generation.greedy_next(fit_model(spark, sf))
    return g.select("ctx", "next", F.round("p", 6).alias("p"))


def q_softmax_temperature(spark, sf):
    m = fit_model(spark, sf)
    s = generation.softmax_temperature(m.bigram, ["ctx"], F.log(F.col("count")))
    return s.select("ctx", "next", F.round("prob", 6).alias("prob"))


def q_temperature_sample(spark, sf):
    m = fit_model(spark, sf)
    return generation.temperature_sample(m.bigram, ["ctx"], "next", "count")


def chat_prompts(spark, sf) -> DataFrame:
    """User turns of the conversations, in the chat template, as prompts."""
    u = conversations(spark, sf).where(F.col("role") == "user")
    text = F.concat(F.lit(USER_PREFIX), F.coalesce("text", F.lit("")), F.lit(USER_SUFFIX))
    return u.select(F.concat_ws("-", "conv_id", "turn").alias("prompt_id"), tokens.encode(text, "hashed").alias("tokens"))


def q_batch_generate(spark, sf):
    g = generation.batch_generate_greedy(chat_prompts(spark, sf), fit_model(spark, sf), MAX_NEW_CHAT)
    return g.select("prompt_id", "n_prompt", F.size("generated").cast("bigint").alias("n_new"), array_md5(F.col("generated")).alias("gen_md5"))


def q_batch_generate_sampled(spark, sf):
    g = generation.batch_generate_sampled(chat_prompts(spark, sf), fit_model(spark, sf), MAX_NEW_CHAT)
    return g.select("prompt_id", "n_prompt", F.size("generated").cast("bigint").alias("n_new"), array_md5(F.col("generated")).alias("gen_md5"))


# --------------------------------------------------------------------------- streams, sinks, resume, scoring, BPE

EVENTS_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"

#: Rows of one file of ``stream_reordered``, and so of a micro-batch: opening and committing the state costs the same for few rows.
EVENT_FILE_ROWS = 2_000_000


def q_stream_prepare(spark, sf):
    from textkiln.sources.corpus import DOCUMENT_SCHEMA

    s = corpus_stream.corpus_stream(spark, corpus_stream.feed(documents(spark, sf, ("doc_id", "text", "lang", "source", "n_chars"))), schema=DOCUMENT_SCHEMA)
    rows = corpus_stream.run_to_table(corpus_stream.stream_prepare(s, tokenizer="hashed"), name="stream-prepare")
    return rows.select(
        "doc_id",
        "n_tokens",
        F.col("crop_start").cast("bigint").alias("crop_start"),
        count_valid(F.col("labels")).cast("bigint").alias("n_targets"),
        F.size("input_ids").cast("bigint").alias("row_len"),
        array_md5(F.col("input_ids")).alias("ids_md5"),
        array_md5(F.col("labels")).alias("labels_md5"),
    )


def q_stream_liquid_filter(spark, sf):
    """Files of later and later events, one a micro-batch: every key's state is carried on."""
    log = spark.read.schema(EVENTS_SCHEMA).parquet(table_path(sf, "events"))
    ev = corpus_stream.corpus_stream(spark, corpus_stream.feed(log, order=["ts", "event_id"]), schema=EVENTS_SCHEMA)
    v = F.col("value")
    out = corpus_stream.run_to_table(liquid_state.stream_liquid_filter(ev, v / 50.0, (v - 50.0) / 50.0), name="stream-liquid")
    return out.select("user_id", "event_id", F.round("h", 6).alias("h"), "late")


def q_stream_reordered(spark, sf):
    """Events that arrive up to an hour after their time, in files of arrival order:
    the watermark and a reorder buffer give every key its rows in event order."""
    log = spark.read.schema(EVENTS_SCHEMA).parquet(table_path(sf, "events"))
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    arrival = at + F.pmod(seeded_u32("arrival", F.col("event_id")), F.lit(3_600_000_000))
    end = log.agg(F.max("ts").alias("ts")).select(
        *[(F.col("ts") + F.expr("INTERVAL 2 HOURS") if f.name == "ts" else F.lit(None).cast(f.dataType)).alias(f.name) for f in log.schema.fields], (at + 3_600_000_000).alias("_arrival")
    )  # a heartbeat at the end, after every arrival, lets the last rows out
    arrived = log.withColumn("_arrival", arrival).unionByName(end)
    ev = corpus_stream.corpus_stream(spark, corpus_stream.feed(arrived, order=["_arrival", "event_id"], rows=EVENT_FILE_ROWS), schema=EVENTS_SCHEMA)
    v = F.col("value")
    with event_time.state_store(spark):
        out = corpus_stream.run_to_table(event_time.stream_ordered_liquid_filter(ev, v / 50.0, (v - 50.0) / 50.0), name="stream-reordered")
    return out.select("user_id", "event_id", F.round("h", 6).alias("h"), "late")


def q_stream_batch_plan(spark, sf):
    """Documents in shuffled order as a stream of files: steps are counted across
    micro-batches, and the stream stops after a step."""
    docs = documents(spark, sf, ("doc_id", "text")).where(F.length("text") > 0).select("doc_id", seeded_hash_hex("shuf", SEED, 0, F.col("doc_id")).alias("key"))
    stream = corpus_stream.corpus_stream(spark, corpus_stream.feed(docs, order=["key", "doc_id"]), schema="doc_id BIGINT, key STRING")
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-plan-{uuid.uuid4().hex}"
    plan = step_stream.run_steps(stream, base, ["key", "doc_id"], max_steps=STREAM_STEPS)
    return plan.select("doc_id", F.col("rank").alias("shuffle_rank"), "micro_step", "global_step")


def q_buffered_shuffle(spark, sf):
    """The corpus in id order, shuffled by a buffer of 1,000 rows."""
    d = spark.read.parquet(table_path(sf, "documents")).select("doc_id")
    return sampling.buffered_shuffle(d, ["doc_id"])


def q_training_rows_sink(spark, sf):
    rows = sampling.shard(corpus_rows(spark, sf), 2).select("doc_id", "shard", "input_ids", "labels")
    path = f"{checkpoint_dir(spark).rstrip('/')}/training-rows-{uuid.uuid4().hex}"
    sinks.write_training_rows(rows, path)
    back = spark.read.parquet(path)
    return back.select(
        "doc_id",
        F.col("shard").cast("int").alias("shard"),
        F.size("input_ids").cast("bigint").alias("row_len"),
        array_md5(F.col("input_ids")).alias("ids_md5"),
        array_md5(F.col("labels")).alias("labels_md5"),
    )


def q_write_corpus_rows(spark, sf):
    """One epoch written in shuffled order within each shard, read back."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/corpus-rows-{uuid.uuid4().hex}"
    training.write_corpus_rows(blanked(spark, sf), path, tokenizer="hashed")
    return spark.read.parquet(path).select(
        "doc_id",
        "shuffle_key",
        F.col("shard").cast("int").alias("shard"),
        F.col("crop_start").cast("bigint").alias("crop_start"),
        array_md5(F.col("input_ids")).alias("ids_md5"),
        array_md5(F.col("labels")).alias("labels_md5"),
    )


def q_resume_remaining(spark, sf):
    """A run stopped after 3 steps of epoch 0, resumed, and stopped after 1 step of
    epoch 1: what its ledger leaves of either epoch."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}"
    docs = documents(spark, sf, ("doc_id", "text"))
    out = None
    for epoch, stop in ((0, 3), (1, 1)):
        plan = training.corpus_plan(docs, epoch=epoch)
        sinks.write_ledger(plan.where(F.col("global_step") <= stop), path, epoch)
        left = sinks.remaining(plan, spark.read.parquet(path), epoch).select(F.lit(epoch).alias("epoch"), "doc_id", "shuffle_rank", "global_step")
        out = left if out is None else out.unionByName(left)
    return out


def q_batch_score(spark, sf):
    m = fit_model(spark, sf)
    d = _doc_lengths(spark, sf)
    scored = evaluation.score_pairs(evaluation.next_token_pairs(d, ["doc_id"]), m, "bigram")
    w = evaluation.window_nll(scored, d.select("doc_id", "L"), ["doc_id"])
    return w.select("doc_id", "i", "trg_len", F.round("mean_nll", 6).alias("mean_nll"))


def q_batch_score_python(spark, sf):
    """Any pandas scorer over the windows' input chunks, in Arrow batches; here the
    share of distinct tokens among a window's inputs."""

    def scorer(pdf):
        share = [len(set(x)) / len(x) for x in pdf["input_chunk"]]
        return pdf[["doc_id", "i"]].assign(distinct=share)

    w = evaluation.window_inputs(doc_tokens(spark, sf).select("doc_id", "tokens"), ["doc_id"])
    s = evaluation.batch_score(w.select("doc_id", "i", "input_chunk"), scorer, "doc_id long, i long, distinct double")
    return s.select("doc_id", "i", F.round("distinct", 6).alias("distinct"))


def q_bpe_encode(spark, sf):
    d = doc_tokens(spark, sf, "bpe")
    return d.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), array_md5(F.col("tokens")).alias("tokens_md5"))


def q_bpe_roundtrip(spark, sf):
    d = doc_tokens(spark, sf, "bpe")
    return d.select("doc_id", (tokens.decode(F.col("tokens")) == F.col("text")).alias("roundtrip_ok"))


def q_corpus_training_rows_bpe(spark, sf):
    r = corpus_rows(spark, sf, "bpe")
    return r.select(
        "doc_id",
        "n_tokens",
        F.col("crop_start").cast("bigint").alias("crop_start"),
        count_valid(F.col("labels")).cast("bigint").alias("n_targets"),
        array_md5(F.col("input_ids")).alias("ids_md5"),
        array_md5(F.col("labels")).alias("labels_md5"),
    )


def q_chat_batch_plan(spark, sf):
    """Instruction-tuning plan: two epochs over the conversations, batch 2,
    accumulation 16, micro-steps continuing across epochs."""
    from textkiln.constants import CHAT_GRAD_ACCUM

    convs = conversations(spark, sf).select("conv_id").distinct()
    p = sampling.multi_epoch_plan(convs, 2, id_col="conv_id", grad_accum=CHAT_GRAD_ACCUM)
    return p.select("conv_id", F.col("epoch").cast("bigint").alias("epoch"), "shuffle_rank", "micro_step", "global_step", "planned_steps")


def q_chat_packing_report(spark, sf):
    """Token budget of the instruction-tuning rows (accumulation 16)."""
    from textkiln.constants import CHAT_GRAD_ACCUM

    rows = chat.chat_training_rows(conversations(spark, sf), tokenizer="hashed")
    return sampling.packing_report(rows, tokens_col="total_tokens", grad_accum=CHAT_GRAD_ACCUM)


# --------------------------------------------------------------------------- skew: one user holds a third of the rows
def hot_events(spark, sf) -> DataFrame:
    """``events`` with every third event moved to user 0: one key then holds a
    third of all rows (the skew the sequence operators must split)."""
    e = events(spark, sf)
    return e.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(0).cast("bigint")).otherwise(F.col("user_id")))


def q_linear_recurrence_hot_key(spark, sf):
    a, b = recurrence_inputs()
    r = sequence.linear_recurrence(hot_events(spark, sf), "user_id", EVENT_ORDER, a, b, h0=1.0, carry=[])
    return r.select("user_id", "event_id", F.round("h", 6).alias("h"))


def q_history_attention_hot_key(spark, sf):
    v = F.col("value")
    h = sequence.history_attention(hot_events(spark, sf), "user_id", EVENT_ORDER, v / 100.0, v / 100.0, v, span=SEQ_LEN)
    return h.select("user_id", "event_id", "pos", F.round("attn", 6).alias("attn"))


def q_trailing_mean_hot_key(spark, sf):
    t = sequence.trailing_mean(hot_events(spark, sf), "user_id", EVENT_ORDER, "value")
    return t.select("user_id", "event_id", F.round("trailing_mean", 6).alias("trailing_mean"))


def q_corpus_training_plan(spark, sf):
    """End-to-end corpus plan (tokenize, shuffle, shard, crop/pad) as written rows."""
    docs = documents(spark, sf)
    r = training.corpus_rows(docs, tokenizer="hashed", num_shards=2)
    ranks = training.corpus_plan(docs).select("doc_id", "shuffle_rank")
    return r.join(ranks, "doc_id").select(
        "doc_id",
        "shuffle_rank",
        "shard",
        F.col("crop_start").cast("bigint").alias("crop_start"),
        array_md5(F.col("input_ids")).alias("ids_md5"),
        array_md5(F.col("labels")).alias("labels_md5"),
    )


def q_temperature_sample_k(spark, sf):
    """Four draws without replacement per context (top-4 Gumbel keys)."""
    m = fit_model(spark, sf)
    return generation.temperature_sample(m.bigram, ["ctx"], "next", "count", k=4).select("ctx", F.col("draw").cast("bigint").alias("draw"), "next")


def q_batch_generate_speed(spark, sf):
    """The speed-run setting: greedy, 100 new tokens, EOT does not stop."""
    from textkiln.constants import MAX_NEW_SPEED

    g = generation.batch_generate_greedy(chat_prompts(spark, sf), fit_model(spark, sf), MAX_NEW_SPEED, stop_at_eot=False)
    return g.select("prompt_id", "n_prompt", F.size("generated").cast("bigint").alias("n_new"), array_md5(F.col("generated")).alias("gen_md5"))


def q_history_attention_vectors(spark, sf):
    """Attention with 64-wide queries and keys: per label, in vec_id order, each
    vector attends over itself and the vectors before it (v = first component)."""
    e = spark.read.parquet(table_path(sf, "embeddings")).select("vec_id", "embedding", "label")
    h = sequence.history_attention(e, "label", ["vec_id"], F.col("embedding"), F.col("embedding"), F.element_at("embedding", 1), span=SEQ_LEN, dim=64)
    return h.select("label", "vec_id", "pos", F.round("attn", 6).alias("attn"))


def q_liquid_filter_vectors(spark, sf):
    """The liquid cell on 64-wide vectors, elementwise over dimensions (as over
    hidden dimensions): per label in vec_id order, gates from x / 2 and x."""
    e = spark.read.parquet(table_path(sf, "embeddings")).select("vec_id", "embedding", "label")
    a = F.transform("embedding", lambda x: sequence.liquid_gates(x / 2.0, x)[0])
    b = F.transform("embedding", lambda x: sequence.liquid_gates(x / 2.0, x)[1])
    r = sequence.linear_recurrence(e, "label", ["vec_id"], a, b, h0=0.0, carry=[])
    return r.select(
        "label",
        "vec_id",
        F.round(F.aggregate("h", F.lit(0.0), lambda acc, x: acc + x), 6).alias("h_sum"),
        F.round(F.element_at("h", 1), 6).alias("h_first"),
    )


def hot_conversations(spark, sf) -> DataFrame:
    """``conversations`` with every third conversation's turns appended to
    conversation 0 (turn = conv_id * 10^9 + turn keeps them ordered): one key
    then holds about a third of all turns."""
    c = conversations(spark, sf)
    hot = F.col("conv_id") % 3 == 0
    return c.select(
        F.when(hot, F.lit(0).cast("bigint")).otherwise(F.col("conv_id")).alias("conv_id"),
        F.when(hot, F.col("conv_id") * 1_000_000_000 + F.col("turn")).otherwise(F.col("turn")).alias("turn"),
        "role",
        "text",
    )


def q_chat_training_rows_hot_key(spark, sf):
    return _chat_report(chat.chat_training_rows(hot_conversations(spark, sf), tokenizer="hashed"))


def repeated_conversations(spark, sf) -> DataFrame:
    """``conversations`` with every turn of every third conversation there twice."""
    c = conversations(spark, sf)
    return c.unionByName(c.where(F.col("conv_id") % 3 == 0))


def q_chat_training_rows_repeated(spark, sf):
    return _chat_report(chat.chat_training_rows(repeated_conversations(spark, sf), tokenizer="hashed"))


# --------------------------------------------------------------------------- null and large keys, null values
def odd_events(spark, sf) -> DataFrame:
    """``events`` with a null user for every fifth user, ids above 2^53 for the others
    (where doubles merge neighbours), and a null value for every eleventh event."""
    user = F.when(F.col("user_id") % 5 != 0, F.col("user_id") + F.lit(2**53))
    return events(spark, sf).withColumns({"user_id": user, "value": F.when(F.col("event_id") % 11 != 5, F.col("value"))})


def user_key():
    """The user as text, so that no comparison reads it as a double."""
    return F.coalesce(F.col("user_id").cast("string"), F.lit("none")).alias("user_key")


def q_linear_recurrence_odd_keys(spark, sf):
    a, b = recurrence_inputs()
    r = sequence.linear_recurrence(odd_events(spark, sf), "user_id", EVENT_ORDER, a, b, h0=1.0, carry=[])
    return r.select(user_key(), "event_id", F.round("h", 6).alias("h"))


def q_liquid_filter_odd_keys(spark, sf):
    v = F.col("value")
    f = sequence.liquid_filter(odd_events(spark, sf), "user_id", EVENT_ORDER, v / 50.0, (v - 50.0) / 50.0, carry=[])
    return f.select(user_key(), "event_id", F.round("h", 6).alias("h"))


def q_causal_softmax_mean_odd_keys(spark, sf):
    e = odd_events(spark, sf).select("user_id", "ts", "event_id", "value")
    c = sequence.causal_softmax_mean(e, "user_id", EVENT_ORDER, F.col("value") / 100.0, F.col("value"))
    return c.select(user_key(), "event_id", F.round("attn", 6).alias("attn"))


def q_batch_generate_sampled_cdf(spark, sf):
    """Temperature generation by inverse CDF (one uniform per prompt and step):
    each step touches one bucket of candidates instead of all continuations."""
    g = generation.batch_generate_sampled_cdf(chat_prompts(spark, sf), fit_model(spark, sf), MAX_NEW_CHAT)
    return g.select("prompt_id", "n_prompt", F.size("generated").cast("bigint").alias("n_new"), array_md5(F.col("generated")).alias("gen_md5"))


def chat_model(spark, sf) -> evaluation.NGramModel:
    """A model of the assistant's turns, which end in EOT."""
    segs = chat.loss_mask(chat.chat_template(conversations(spark, sf).where(F.col("role") == "assistant")), "hashed")
    return evaluation.ngram_fit(segs.select(F.col("seg_ids").alias("tokens")))


def q_batch_generate_interpolated(spark, sf):
    """Answers sampled from the interpolated model at temperature 0.8; EOT ends them."""
    g = generation.batch_generate_interpolated(chat_prompts(spark, sf), chat_model(spark, sf), MAX_NEW_CHAT)
    return g.select("prompt_id", "n_prompt", F.size("generated").cast("bigint").alias("n_new"), array_md5(F.col("generated")).alias("gen_md5"))
