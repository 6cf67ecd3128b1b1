"""Held-out evaluation: next-token pairs, an n-gram model, masked cross-entropy,
strided windows and sliding-window perplexity, model comparison.

The neural model of the training scripts is re-aimed as an n-gram model fitted
with one aggregation; scoring is a join of (context, next) pairs to its tables.
Window arithmetic follows the strided evaluation loop exactly: window ``i``
(0, stride, 2*stride, ...) spans ``[max(i + stride - max_len, 0), min(i + stride, L))``,
its targets are ``[max(i, 1), end)`` and its mean loss is weighted by
``trg_len = end - i``; the total is divided by ``L``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textkiln.constants import IGNORE, SEQ_LEN, STRIDE, VOCAB_SIZE
from textkiln.session import materialize


#: Distinct pairs a shuffle partition of the model may hold in a hash table (tens of MB).
HASHED_PAIRS = 500_000


# --------------------------------------------------------------------------- pairs
def next_token_pairs(
    df: DataFrame,
    key_cols: list[str],
    tokens_col: str = "tokens",
    base_pos: Column | None = None,
    prev_token: Column | None = None,
) -> DataFrame:
    """``(*keys, pos, ctx, next)``: token ``pos`` predicted from token ``pos - 1``.

    Arrays are zipped with their own shift (no window, no shuffle). For a long
    sequence cut into rows, ``base_pos`` is the row's first position and
    ``prev_token`` the last token of the row before (NULL for the first row).
    """
    t = F.col(tokens_col)
    base = base_pos if base_pos is not None else F.lit(0)
    if prev_token is not None:
        ext = F.when(prev_token.isNotNull(), F.concat(F.array(prev_token.cast("int")), t)).otherwise(t)
        first = F.when(prev_token.isNotNull(), base).otherwise(base + 1)
    else:
        ext, first = t, base + 1
    n = F.greatest(F.size(ext) - 1, F.lit(0))
    zipped = F.arrays_zip(F.slice(ext, 1, n).alias("ctx"), F.slice(ext, 2, n).alias("next"))
    # an outer explode and a filter on the pair: Catalyst would build the pairs a second time for an inner one's filter
    d = df.select(*key_cols, first.alias("_first"), F.posexplode_outer(zipped).alias("_i", "_p")).where("_p is not null")
    return d.select(*key_cols, (F.col("_first") + F.col("_i")).cast("bigint").alias("pos"), "_p.ctx", "_p.next")


def label_pairs(rows: DataFrame, key_cols: list[str], ids_col: str = "input_ids", labels_col: str = "labels") -> DataFrame:
    """Shifted training pairs ``(ctx = ids[t-1], next = labels[t])`` whose label is
    not IGNORE."""
    ids, lab = F.col(ids_col), F.col(labels_col)
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    zipped = F.arrays_zip(F.slice(ids, 1, n).alias("ctx"), F.slice(lab, 2, n).alias("next"))
    # outer, so that the pairs are built once; the null of a row without pairs fails the filter
    return rows.select(*key_cols, F.explode_outer(zipped).alias("_p")).where(F.col("_p.next") != IGNORE).select(*key_cols, "_p.ctx", "_p.next")


# --------------------------------------------------------------------------- n-gram model
@dataclass
class NGramModel:
    """Counts of a unigram/bigram model; ``n_tokens`` and ``vocab`` are scalars.

    ``unigram`` (token, count) and ``context`` (ctx, total) have at most one row
    per vocabulary id, which is the bound that lets them be broadcast.
    """

    unigram: DataFrame
    bigram: DataFrame
    context: DataFrame
    n_tokens: int
    vocab: int
    n_bigrams: int = 0

    def unigram_prob(self, count: Column) -> Column:
        return (F.coalesce(count, F.lit(0)) + F.lit(1)) / F.lit(float(self.n_tokens + self.vocab))

    def per_token(self, df: DataFrame) -> DataFrame:
        """Broadcast a per-token table (unigram, context totals) when the fitted
        model's distinct-token count, which bounds its rows, is vocabulary-sized;
        otherwise leave the join to the planner."""
        return F.broadcast(df) if self.vocab - 1 <= VOCAB_SIZE else df


def ngram_fit(train: DataFrame, tokens_col: str = "tokens", key_cols: list[str] | None = None) -> NGramModel:
    """Fit add-one unigram and interpolated bigram counts on token arrays.

    One pass: every position becomes ``(ctx, next)`` (ctx NULL for a row's first
    token), counted with a partial + final hash aggregate. The count table is
    written as a table in the shared checkpoint folder (it feeds several joins); unigram and
    context totals are aggregates of it.
    """
    t = F.col(tokens_col)
    n = F.size(t)
    ext = F.concat(F.array(F.lit(None).cast("int")), t)
    pairs = F.arrays_zip(F.slice(ext, 1, n).alias("ctx"), t.alias("next"))
    # no filter on the token column here: Catalyst would push it below any repartition of
    # the input and evaluate the tokenizer twice; an inner explode gets such a filter too
    counts = (
        train.select(F.explode_outer(pairs).alias("_p")).where("_p is not null")
        .groupBy(F.col("_p.ctx").alias("ctx"), F.col("_p.next").alias("next"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    counts = materialize(counts, "ngram-counts")
    uni = counts.groupBy(F.col("next").alias("token")).agg(F.sum("count").alias("count"))
    big = counts.where(F.col("ctx").isNotNull())
    ctx = big.groupBy("ctx").agg(F.sum("count").alias("total"))
    # scalars of the fitted model in one pass: total tokens, vocabulary (+1 for
    # unseen tokens) and the number of distinct (ctx, next) pairs
    st = counts.agg(
        F.sum("count").alias("n"), F.countDistinct("next").alias("v"), F.count("ctx").alias("b")
    ).first()
    return NGramModel(uni, big, ctx, int(st["n"] or 0), int(st["v"] or 0) + 1, int(st["b"] or 0))


def score_pairs(pairs: DataFrame, model: NGramModel, kind: str = "bigram", lam: float = 0.9) -> DataFrame:
    """Add ``p`` and ``nll = -ln p`` for each (ctx, next) pair.

    bigram: ``lam * c(ctx, next) / c(ctx) + (1 - lam) * q(next)``, or ``q(next)``
    when the context was never seen; unigram: ``q(next) = (c + 1) / (N + V)``.
    """
    if kind not in ("unigram", "bigram"):
        raise ValueError(kind)
    d = score_models(pairs, model, [kind], lam)
    return d.withColumnRenamed(f"p_{kind}", "p").withColumnRenamed(f"nll_{kind}", "nll")


def score_models(pairs: DataFrame, model: NGramModel, kinds: list[str], lam: float = 0.9) -> DataFrame:
    """Add ``p_<kind>`` and ``nll_<kind>`` for several models in one pass: the
    unigram and context tables (one row per vocabulary id at most) are
    broadcast; the bigram table, unbounded, is a shuffled join (AQE splits a
    hot pair)."""
    uni = model.per_token(model.unigram.select(F.col("token").alias("next"), F.col("count").alias("_c_uni")))
    d, q = pairs, model.unigram_prob(F.col("_c_uni"))
    has_next = F.col("next").isNotNull()
    if "bigram" in kinds:  # the shuffled join first: nothing that can be broadcast later is shuffled with the pairs
        ctx = model.per_token(model.context.select("ctx", F.col("total").alias("_c_ctx")))
        big = model.bigram.select("ctx", "next", F.col("count").alias("_c_big"))
        parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        big = big.hint("shuffle_hash") if model.n_bigrams <= HASHED_PAIRS * parts else big  # no sort of the pairs
        d = d.join(big, ["ctx", "next"], "left").join(ctx, "ctx", "left")
    d = d.join(uni, "next", "left")
    for kind in kinds:
        if kind == "unigram":
            p = q
        else:
            p = F.when(
                F.col("_c_ctx").isNotNull(),
                F.lit(lam) * F.coalesce(F.col("_c_big"), F.lit(0)) / F.col("_c_ctx") + F.lit(round(1.0 - lam, 12)) * q,
            ).otherwise(q)
        d = d.withColumn(f"p_{kind}", F.when(has_next, p)).withColumn(f"nll_{kind}", -F.log(F.col(f"p_{kind}")))
    return d.drop(*[c for c in ("_c_uni", "_c_ctx", "_c_big") if c in d.columns])


def masked_cross_entropy(rows: DataFrame, model: NGramModel, key_cols: list[str], kind: str = "bigram") -> DataFrame:
    """Per training row: valid targets, summed and mean NLL (NULL when no target)."""
    # gathered by row first: summed where the join leaves them, hardly two pairs of a row meet
    s = score_pairs(label_pairs(rows, key_cols), model, kind).repartition(*key_cols)
    sums = s.groupBy(*key_cols).agg(F.count("nll").alias("n_valid"), F.sum("nll").alias("sum_nll"), F.avg("nll").alias("mean_nll"))
    # rows without a target have no pair, so no null pairs have to meet in the model's joins
    keys = rows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key_cols)])
    on = F.lit(True)
    for i, k in enumerate(key_cols):
        on = on & F.col(f"_k{i}").eqNullSafe(F.col(k))
    joined = keys.join(sums, on, "left")
    return joined.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(key_cols)], F.coalesce("n_valid", F.lit(0).cast("bigint")).alias("n_valid"), "sum_nll", "mean_nll")


# --------------------------------------------------------------------------- windows
def sliding_windows(lengths: DataFrame, key_cols: list[str], length_col: str = "L", stride: int = STRIDE, max_len: int = SEQ_LEN) -> DataFrame:
    """``(*keys, i, begin_loc, end_loc, trg_len)`` for i = 0, stride, ... < L."""
    d = lengths.where(F.col(length_col) > 0).select(
        *key_cols, length_col, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(length_col) - 1, F.lit(stride).cast("bigint"))).alias("i")
    )
    end = F.least(F.col("i") + stride, F.col(length_col))
    return d.select(
        *key_cols,
        length_col,
        "i",
        F.greatest(F.col("i") + stride - max_len, F.lit(0)).cast("bigint").alias("begin_loc"),
        end.cast("bigint").alias("end_loc"),
        (end - F.col("i")).cast("bigint").alias("trg_len"),
    )


def window_membership(positions: DataFrame, key_cols: list[str], length_col: str = "L", stride: int = STRIDE, max_len: int = SEQ_LEN) -> DataFrame:
    """Each position's windows and role: ``target`` in window ``floor(pos/stride)``
    (pos >= 1), ``context`` in every window whose inputs include it but whose
    targets do not. Range membership becomes an ``explode`` of a short sequence."""
    pos, L = F.col("pos"), F.col(length_col)
    tgt = F.when(pos >= 1, F.array(F.struct((F.floor(pos / stride) * stride).cast("bigint").alias("i"), F.lit("target").alias("role"))))
    lo = F.floor(pos / stride) + 1
    hi = F.floor((pos + max_len - stride) / stride)
    ctx_ids = F.when(hi >= lo, F.sequence(lo.cast("bigint"), hi.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    ctx = F.transform(
        F.filter(F.transform(ctx_ids, lambda k: k * stride), lambda i: i < L),
        lambda i: F.struct(i.alias("i"), F.lit("context").alias("role")),
    )
    first = F.when(pos == 0, F.array(F.struct(F.lit(0).cast("bigint").alias("i"), F.lit("context").alias("role"))))
    allm = F.concat(F.coalesce(tgt, F.array().cast("array<struct<i:bigint,role:string>>")), ctx, F.coalesce(first, F.array().cast("array<struct<i:bigint,role:string>>")))
    return positions.select(*key_cols, "pos", F.explode(allm).alias("_m")).select(*key_cols, "pos", "_m.i", "_m.role")


def window_nll(scored: DataFrame, lengths: DataFrame, key_cols: list[str], length_col: str = "L", stride: int = STRIDE, max_len: int = SEQ_LEN) -> DataFrame:
    """Built-in window scorer: every window of ``sliding_windows`` with the mean NLL
    of its targets (NULL when it has none). ``scored`` has ``(*keys, pos, nll)``.
    Each target position belongs to exactly one window, so this is one grouped
    aggregate joined to the window list -- no per-window Python."""
    per_win = (
        scored.where(F.col("pos") >= 1)
        .select(*key_cols, (F.floor(F.col("pos") / stride) * stride).cast("bigint").alias("i"), "nll")
        .repartition(*key_cols, "i")  # gathered first: where a join leaves the positions, hardly two of a window meet
        .groupBy(*key_cols, "i")
        .agg(F.avg("nll").alias("mean_nll"), F.count("nll").alias("n_targets"))
    )
    wins = sliding_windows(lengths, key_cols, length_col, stride, max_len)
    return wins.join(per_win, [*key_cols, "i"], "left")


def batch_score(windows: DataFrame, scorer, schema: str) -> DataFrame:
    """Run any ``pandas.DataFrame -> pandas.DataFrame`` scorer over Arrow batches
    of windows (e.g. a model that needs Python); the built-in scorer is ``window_nll``."""

    def run(batches):
        for pdf in batches:
            yield scorer(pdf)

    return windows.mapInPandas(run, schema)


def window_inputs(seqs: DataFrame, key_cols: list[str], tokens_col: str = "tokens", stride: int = STRIDE, max_len: int = SEQ_LEN) -> DataFrame:
    """Windows with their input chunk ``tokens[begin:end]`` and ``trg_len``."""
    lengths = seqs.select(*key_cols, tokens_col, F.size(tokens_col).cast("bigint").alias("L"))
    w = sliding_windows(lengths, key_cols + [tokens_col], "L", stride, max_len)
    chunk = F.slice(tokens_col, (F.col("begin_loc") + 1).cast("int"), (F.col("end_loc") - F.col("begin_loc")).cast("int"))
    return w.select(*key_cols, "i", "begin_loc", "end_loc", "trg_len", chunk.alias("input_chunk"))


def sliding_perplexity(scored: DataFrame, lengths: DataFrame, key_cols: list[str], length_col: str = "L", stride: int = STRIDE, max_len: int = SEQ_LEN) -> DataFrame:
    """Perplexity per sequence: ``exp(sum_w mean_nll(w) * trg_len(w) / L)``; a
    window without targets (L = 1) makes it NULL."""
    j = window_nll(scored, lengths, key_cols, length_col, stride, max_len)
    return j.groupBy(*key_cols).agg(
        F.first(length_col).alias("n_tokens"),
        F.count(F.lit(1)).alias("n_windows"),
        F.coalesce(F.sum("n_targets"), F.lit(0)).alias("n_targets"),
        F.exp(F.sum(F.col("mean_nll") * F.col("trg_len")) / F.first(length_col)).alias("ppl"),
    )


def model_comparison(results: list[DataFrame]) -> DataFrame:
    """Union per-model result rows (``model``, ``ppl``, ...) and flag the best
    (lowest perplexity); the number of models bounds the final window."""
    from pyspark.sql import Window

    u = results[0]
    for r in results[1:]:
        u = u.unionByName(r)
    w = Window.partitionBy()
    return u.withColumn("best", F.col("ppl") == F.min("ppl").over(w))


def metric_pivot(results: DataFrame, metrics: list[str], model_col: str = "model") -> DataFrame:
    """Report with one row per metric and one column per model (the models bound the
    columns)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    long = results.select(model_col, pairs.alias("p")).select(model_col, "p.metric", "p.value")
    return long.groupBy("metric").pivot(model_col).agg(F.first("value"))


def accumulate_steps(row_losses: DataFrame, plan: DataFrame, key: str = "doc_id") -> DataFrame:
    """Gradient-accumulation view of a loss series: a micro-step's loss is the
    mean over the valid tokens of its rows together; a global step reports the
    mean of its micro losses and the last micro-step's loss (what gets logged)."""
    d = plan.join(row_losses, key)
    micro = d.groupBy("global_step", "micro_step").agg((F.sum("sum_nll") / F.sum("n_valid")).alias("micro_loss"))
    return micro.groupBy("global_step").agg(
        F.count(F.lit(1)).alias("n_micro"),
        F.avg("micro_loss").alias("mean_loss"),
        F.max_by("micro_loss", "micro_step").alias("logged_loss"),
    )
