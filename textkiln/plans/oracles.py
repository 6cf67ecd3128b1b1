"""DuckDB twins of the registered queries (tables are pre-registered views)."""

from __future__ import annotations

from textkiln.constants import EOT, SEED, SHUFFLE_BUFFER, STREAM_STEPS
from textkiln.plans.sqlparts import arr_md5, count_valid, hashed_ids, pad, seeded_key, u32

DOC_TOKENS = f"""doc_tokens AS (
  SELECT doc_id, lang, source, {hashed_ids('text')} AS tokens
  FROM documents WHERE length(coalesce(text, '')) > 0
), doc_tok AS (SELECT * FROM doc_tokens WHERE len(tokens) > 0)"""

CHAT_CTE = f"""WITH seg AS (
  SELECT conv_id, turn, role,
    CASE WHEN role = 'user' THEN {hashed_ids("'User: ' || coalesce(text, '') || chr(10) || 'Assistant: '")}
         WHEN role = 'assistant' THEN list_append({hashed_ids('text')}, {EOT})
         ELSE []::INTEGER[] END AS ids
  FROM conversations
), lab AS (
  SELECT conv_id, turn, ids,
    CASE WHEN role = 'user' THEN list_transform(ids, lambda x: (-100)::INTEGER) ELSE ids END AS labels
  FROM seg
), conv AS (
  SELECT conv_id, flatten(list(ids ORDER BY turn)) AS ids, flatten(list(labels ORDER BY turn)) AS labels
  FROM lab GROUP BY conv_id
), cut AS (
  SELECT conv_id, len(ids) AS total_tokens, list_slice(ids, 1, 1024) AS ids, list_slice(labels, 1, 1024) AS labels FROM conv
), padded AS (
  SELECT conv_id, total_tokens, len(ids) AS n_tokens, {pad('ids', 1024, EOT)} AS input_ids, {pad('labels', 1024, -100)} AS labels
  FROM cut
)"""

CHAT_ROWS = CHAT_CTE + f"""
SELECT conv_id, n_tokens::BIGINT AS n_tokens, total_tokens::BIGINT AS total_tokens,
  {count_valid('labels')}::BIGINT AS n_targets, total_tokens > 1024 AS truncated,
  {count_valid('labels')} = 0 AS zero_target,
  {arr_md5('input_ids')} AS ids_md5, {arr_md5('labels')} AS labels_md5
FROM padded"""

SHUF_KEY = f"md5({seeded_key('shuf', str(SEED), '0', 'doc_id')})"
CROP_U32 = u32(seeded_key("crop", str(SEED), "0", "doc_id"))

CORPUS_ROWS = f"""WITH {DOC_TOKENS},
rows AS (
  SELECT doc_id, tokens, len(tokens) AS n_tokens,
    CASE WHEN len(tokens) > 1024 THEN {CROP_U32} % (len(tokens) - 1024 + 1) ELSE 0 END AS crop_start
  FROM doc_tok
), built AS (
  SELECT doc_id, n_tokens, crop_start,
    CASE WHEN n_tokens > 1024 THEN list_slice(tokens, crop_start + 1, crop_start + 1024) ELSE {pad('tokens', 1024, EOT)} END AS input_ids,
    CASE WHEN n_tokens > 1024 THEN list_slice(tokens, crop_start + 1, crop_start + 1024) ELSE {pad('tokens', 1024, -100)} END AS labels
  FROM rows
)"""


BLANKED = "(SELECT * REPLACE (CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS text) FROM documents)"

ALL_ROWS = f"""{DOC_TOKENS},
cuts AS (SELECT doc_id, tokens, unnest(range(0, ((len(tokens) + 1023) // 1024)::BIGINT)) AS row_no FROM doc_tok),
runs AS (SELECT doc_id, row_no, list_slice(tokens, row_no * 1024 + 1, row_no * 1024 + 1024) AS t FROM cuts),
lp AS (SELECT doc_id, row_no, t[k - 1] AS ctx, t[k] AS nxt FROM (SELECT doc_id, row_no, t, unnest(range(2, len(t) + 1)) AS k FROM runs))"""


def oracles() -> dict[str, str]:
    q: dict[str, str] = {}
    q["chat_training_rows"] = CHAT_ROWS
    q["corpus_scan"] = (
        "SELECT doc_id, lang, source, length(text)::BIGINT AS n_chars, md5(text) AS text_md5 FROM documents"
    )
    q["chat_scan"] = """SELECT conv_id, count(*)::BIGINT AS n_messages,
  string_agg(role, ',' ORDER BY turn) AS roles,
  md5(string_agg(text, chr(1) ORDER BY turn)) AS content_md5
FROM conversations GROUP BY conv_id"""
    q["chat_roundtrip"] = """SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS turn, role, text
FROM conversations"""
    q["chat_template"] = """SELECT conv_id, turn, role,
  CASE WHEN role = 'user' THEN 'User: ' || coalesce(text, '') || chr(10) || 'Assistant: ' ELSE coalesce(text, '') END AS segment
FROM conversations WHERE role IN ('user', 'assistant')"""
    from textkiln.constants import PIECE_PATTERN
    from textkiln.plans.sqlparts import lit

    q["pretokenize"] = f"""SELECT doc_id, len(p)::BIGINT AS n_pieces, md5(array_to_string(p, chr(1))) AS pieces_md5
FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {lit(PIECE_PATTERN)}) AS p FROM documents)"""
    q["drop_empty"] = f"WITH {DOC_TOKENS} SELECT doc_id, len(tokens)::BIGINT AS n_tokens FROM doc_tok"
    q["token_counts"] = f"""WITH {DOC_TOKENS}
SELECT lang, source, count(*)::BIGINT AS n_docs, sum(len(tokens))::BIGINT AS n_tokens, max(len(tokens))::BIGINT AS max_tokens
FROM doc_tok GROUP BY lang, source"""
    q["seeded_shuffle"] = f"SELECT doc_id, (row_number() OVER (ORDER BY {SHUF_KEY}, doc_id) - 1)::BIGINT AS shuffle_rank FROM documents"
    q["shard"] = f"SELECT doc_id, ({u32(seeded_key('shard', str(SEED), '0', 'doc_id'))} % 2)::INTEGER AS shard FROM documents"
    q["corpus_training_rows"] = f"""{CORPUS_ROWS}
SELECT doc_id, n_tokens::BIGINT AS n_tokens, crop_start::BIGINT AS crop_start, {count_valid('labels')}::BIGINT AS n_targets,
  len(input_ids)::BIGINT AS row_len, {arr_md5('input_ids')} AS ids_md5, {arr_md5('labels')} AS labels_md5
FROM built"""
    def plan(texts: str) -> str:
        return f"""WITH k AS (SELECT doc_id FROM {texts} WHERE length(text) > 0),
r AS (SELECT doc_id, (row_number() OVER (ORDER BY {SHUF_KEY}, doc_id) - 1)::BIGINT AS shuffle_rank FROM k),
p AS (SELECT doc_id, shuffle_rank, shuffle_rank // 2 AS micro_step, (shuffle_rank // 2) // 64 + 1 AS global_step FROM r),
s AS (SELECT *, count(*) OVER (PARTITION BY global_step) AS step_rows FROM p)
SELECT doc_id, shuffle_rank, micro_step::BIGINT AS micro_step, global_step::BIGINT AS global_step, step_rows = 128 AS step_complete FROM s"""

    q["batch_plan"] = plan("documents")
    q["buffered_shuffle"] = f"""WITH p AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, {u32(seeded_key('buffer', str(SEED), '0', 'doc_id'))} AS draw FROM documents)
SELECT doc_id, (row_number() OVER (ORDER BY place + floor(draw * {SHUFFLE_BUFFER}::DOUBLE / 4294967296), draw, place) - 1)::BIGINT AS shuffle_rank FROM p"""
    q["stream_batch_plan"] = f"SELECT doc_id, shuffle_rank, micro_step, global_step FROM ({plan('documents')}) WHERE global_step <= {STREAM_STEPS}"
    q["batch_plan_with_empty"] = plan(BLANKED)
    q["packing_report"] = f"""{CORPUS_ROWS},
a AS (
  SELECT count(*)::BIGINT AS n_rows, sum(least(n_tokens, 1024))::BIGINT AS n_tokens,
    sum(greatest(1024 - n_tokens, 0))::BIGINT AS n_pad, sum({count_valid('labels')})::BIGINT AS n_targets,
    sum((n_tokens > 1024)::INTEGER)::BIGINT AS n_cropped
  FROM built
)
SELECT n_rows, n_tokens, n_pad, n_targets, n_cropped, (n_rows * 1024)::BIGINT AS token_budget,
  ((n_rows + 1) // 2)::BIGINT AS micro_steps, (((n_rows + 1) // 2) // 64)::BIGINT AS global_steps,
  round(n_pad / (n_rows * 1024), 6) AS pad_share, round(n_targets / (n_rows * 1024), 6) AS target_share
FROM a"""
    q["head_truncate"] = f"""WITH {DOC_TOKENS}
SELECT doc_id, len(list_slice(tokens, 1, 1024))::BIGINT AS n_head, {arr_md5('list_slice(tokens, 1, 1024)')} AS head_md5 FROM doc_tok"""
    q["tail_context"] = f"""WITH {DOC_TOKENS}
SELECT doc_id, least(len(tokens), 1024)::BIGINT AS n_ctx,
  {arr_md5('list_slice(tokens, len(tokens) - least(len(tokens), 1024) + 1, len(tokens))')} AS ctx_md5 FROM doc_tok"""
    q.update(eval_oracles())
    q.update(seq_oracles())
    q.update(gen_oracles())
    q.update(misc_oracles(q))
    q.update(plan_oracles())
    q.update(hot_oracles(q))
    return q


# ----------------------------------------------------------------- evaluation twins
MODEL = f"""train AS (
  SELECT doc_id, {hashed_ids('text')} AS t FROM documents WHERE length(coalesce(text, '')) > 0
), tr AS (SELECT * FROM train WHERE len(t) > 0
), toks AS (SELECT doc_id, generate_subscripts(t, 1) AS i, unnest(t) AS tok FROM tr
), uni AS (SELECT tok, count(*) AS c FROM toks GROUP BY tok
), st AS (SELECT sum(c) AS n, count(*) + 1 AS v FROM uni
), tp AS (SELECT doc_id, i, lag(tok) OVER (PARTITION BY doc_id ORDER BY i) AS ctx, tok AS nxt FROM toks
), big AS (SELECT ctx, nxt, count(*) AS c FROM tp WHERE ctx IS NOT NULL GROUP BY ctx, nxt
), cx AS (SELECT ctx, sum(c) AS total FROM big GROUP BY ctx)"""


def scored(rel: str, kind: str = "bigram") -> str:
    """Score ``rel(…, ctx, nxt)``: adds p and nll (twin of ``evaluation.score_pairs``)."""
    q = "(coalesce(uni.c, 0) + 1)::DOUBLE / (st.n + st.v)::DOUBLE"
    if kind == "unigram":
        p = q
    else:
        p = f"CASE WHEN cx.total IS NOT NULL THEN 0.9::DOUBLE * coalesce(big.c, 0) / cx.total + 0.1::DOUBLE * {q} ELSE {q} END"
    return f"""(SELECT r.*, {p} AS p, -ln({p}) AS nll
  FROM {rel} r CROSS JOIN st LEFT JOIN uni ON uni.tok = r.nxt LEFT JOIN cx ON cx.ctx = r.ctx
  LEFT JOIN big ON big.ctx = r.ctx AND big.nxt = r.nxt)"""


HELDOUT = f"""j AS (SELECT string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY item_id) AS s FROM benchmark
), ht AS (SELECT {hashed_ids('s')} AS t FROM j
), hp AS (SELECT generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS tok FROM ht
), hpairs AS (SELECT pos, lag(tok) OVER (ORDER BY pos) AS ctx, tok AS nxt FROM hp)"""


def perplexity(scored_rel: str, lengths_rel: str, key: str) -> str:
    """Twin of ``evaluation.sliding_perplexity`` over ``scored_rel(key, pos, nll)``."""
    return f"""(WITH w AS (SELECT {key}, L, unnest(range(0, L, 512)) AS i FROM {lengths_rel} WHERE L > 0),
  pw AS (SELECT {key}, (pos // 512) * 512 AS i, avg(nll) AS m, count(nll) AS nt FROM {scored_rel} WHERE pos >= 1 GROUP BY ALL),
  ww AS (SELECT w.{key}, w.L, w.i, least(w.i + 512, w.L) - w.i AS trg_len, pw.m, pw.nt FROM w LEFT JOIN pw USING ({key}, i))
  SELECT {key}, any_value(L)::BIGINT AS n_tokens, count(*)::BIGINT AS n_windows, coalesce(sum(nt), 0)::BIGINT AS n_targets,
    exp(sum(m * trg_len) / any_value(L)) AS ppl
  FROM ww GROUP BY {key})"""


def eval_oracles() -> dict[str, str]:
    q: dict[str, str] = {}
    q["next_token_pairs"] = f"""WITH {DOC_TOKENS},
toks AS (SELECT doc_id, generate_subscripts(tokens, 1) - 1 AS pos, unnest(tokens) AS tok FROM doc_tok),
pr AS (SELECT doc_id, pos, lag(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS ctx, tok AS nxt FROM toks)
SELECT doc_id, count(*)::BIGINT AS n_pairs, sum(pos * (ctx + 1) + nxt)::BIGINT AS checksum FROM pr WHERE ctx IS NOT NULL GROUP BY doc_id"""
    q["ngram_fit"] = f"""WITH {MODEL}
SELECT big.ctx, any_value(cx.total)::BIGINT AS n_ctx, count(*)::BIGINT AS n_next,
  round(max(0.9::DOUBLE * big.c / cx.total + 0.1::DOUBLE * ((coalesce(uni.c, 0) + 1)::DOUBLE / (st.n + st.v)::DOUBLE)), 6) AS p_top
FROM big JOIN cx USING (ctx) LEFT JOIN uni ON uni.tok = big.nxt CROSS JOIN st GROUP BY big.ctx"""
    q["next_token_nll"] = f"""WITH {MODEL}, {HELDOUT},
pr AS (SELECT pos, ctx, nxt FROM hpairs WHERE ctx IS NOT NULL)
SELECT pos::BIGINT AS pos, ctx, nxt AS next, round(nll, 6) AS nll FROM {scored('pr')}"""
    q["masked_cross_entropy"] = f"""WITH {ALL_ROWS}, {MODEL},
s AS {scored('lp')}
SELECT b.doc_id, b.row_no, count(s.nll)::BIGINT AS n_valid, round(avg(s.nll), 6) AS mean_nll
FROM runs b LEFT JOIN s USING (doc_id, row_no) GROUP BY b.doc_id, b.row_no"""
    chat_ce = f"""{CHAT_CTE}, {MODEL},
lp AS (SELECT conv_id, input_ids[k - 1] AS ctx, labels[k] AS nxt
  FROM (SELECT conv_id, input_ids, labels, unnest(range(2, 1025)) AS k FROM padded) WHERE labels[k] <> -100),
s AS {scored('lp')},
ce AS (SELECT b.conv_id, count(s.nll) AS n_valid, sum(s.nll) AS sum_nll, avg(s.nll) AS mean_nll FROM padded b LEFT JOIN s USING (conv_id) GROUP BY b.conv_id)"""
    q["chat_masked_cross_entropy"] = f"{chat_ce} SELECT conv_id, n_valid::BIGINT AS n_valid, round(mean_nll, 6) AS mean_nll FROM ce"
    ranks = " UNION ALL ".join(
        f"SELECT conv_id, {e} AS epoch, (row_number() OVER (ORDER BY md5({seeded_key('shuf', str(SEED), str(e), 'conv_id')}), conv_id) - 1) AS rk FROM ce" for e in (0, 1)
    )
    q["loss_curve"] = f"""{chat_ce},
r AS ({ranks}),
p AS (SELECT conv_id, epoch * (SELECT (count(*) + 1) // 2 FROM ce) + rk // 2 AS micro_step FROM r),
m AS (SELECT micro_step, micro_step // 16 + 1 AS global_step, sum(sum_nll) / sum(n_valid) AS loss FROM p JOIN ce USING (conv_id) GROUP BY micro_step),
g AS (SELECT global_step, arg_max(loss, micro_step) AS logged FROM m GROUP BY global_step),
t AS (SELECT global_step, logged, avg(logged) OVER w AS smoothed, count(logged) OVER w AS n FROM g WINDOW w AS (ORDER BY global_step ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT global_step::BIGINT AS global_step, round(logged, 6) AS logged_loss, round(smoothed, 6) AS smoothed FROM t WHERE n = 3"""
    q["sliding_windows"] = f"""WITH {DOC_TOKENS},
w AS (SELECT doc_id, len(tokens) AS L, unnest(range(0, len(tokens), 512)) AS i FROM doc_tok)
SELECT doc_id, i::BIGINT AS i, greatest(i + 512 - 1024, 0)::BIGINT AS begin_loc, least(i + 512, L)::BIGINT AS end_loc,
  (least(i + 512, L) - i)::BIGINT AS trg_len FROM w"""
    q["window_membership"] = f"""WITH {DOC_TOKENS},
w AS (SELECT doc_id, len(tokens) AS L, unnest(range(0, len(tokens), 512)) AS i FROM doc_tok),
b AS (SELECT doc_id, L, i, greatest(i + 512 - 1024, 0) AS b, least(i + 512, L) AS e FROM w)
SELECT doc_id, i::BIGINT AS i, (e - greatest(i, 1))::BIGINT AS n_target, (greatest(i, 1) - b)::BIGINT AS n_context FROM b"""
    q["sliding_perplexity"] = f"""WITH {MODEL},
it AS (SELECT item_id, {hashed_ids('text')} AS t FROM benchmark WHERE length(coalesce(text, '')) > 0),
itn AS (SELECT item_id, t FROM it WHERE len(t) > 0),
lens AS (SELECT item_id, len(t) AS L FROM itn),
ip AS (SELECT item_id, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS tok FROM itn),
pr AS (SELECT item_id, pos, lag(tok) OVER (PARTITION BY item_id ORDER BY pos) AS ctx, tok AS nxt FROM ip),
sc AS (SELECT * FROM {scored('(SELECT * FROM pr WHERE ctx IS NOT NULL)')})
SELECT item_id, n_tokens, n_windows, n_targets, round(ppl, 6) AS ppl FROM {perplexity('sc', 'lens', 'item_id')}"""
    parts = []
    for kind, table in (("unigram", "uni"), ("bigram", "big")):
        parts.append(
            f"""SELECT '{kind}' AS model, round(ppl, 6) AS ppl, printf('%.2f', ppl) AS ppl_text, n_tokens AS eval_tokens, n_windows,
  (SELECT count(*) FROM {table})::BIGINT AS model_entries
FROM {perplexity(f"(SELECT 0 AS seq, * FROM {scored('(SELECT * FROM hpairs WHERE ctx IS NOT NULL)', kind)})", '(SELECT 0 AS seq, count(*) AS L FROM hp)', 'seq')}"""
        )
    q["model_comparison"] = f"""WITH {MODEL}, {HELDOUT}, res AS ({parts[0]} UNION ALL {parts[1]})
SELECT *, ppl = min(ppl) OVER () AS best FROM res"""
    q["corpus_concat_prefix"] = """WITH o AS (
  SELECT doc_id, coalesce(text, '') AS t,
    coalesce(sum(length(coalesce(text, '')) + 2) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM documents
), s AS (
  SELECT doc_id AS seg_id, CASE WHEN off = 0 THEN 0 ELSE off - 2 END AS seg_start,
    CASE WHEN off = 0 THEN t ELSE chr(10) || chr(10) || t END AS seg FROM o
)
SELECT seg_id, seg_start::BIGINT AS seg_start, length(left(seg, (200000 - seg_start)::INTEGER))::BIGINT AS n_chars,
  md5(left(seg, (200000 - seg_start)::INTEGER)) AS segment_md5
FROM s WHERE seg_start < 200000"""
    q["heldout_tokens"] = f"WITH {HELDOUT} SELECT pos::BIGINT AS pos, tok AS token FROM hp"
    row_id = "doc_id || '-' || row_no"
    q["accumulate_steps"] = f"""WITH {ALL_ROWS}, {MODEL},
s AS {scored('lp')},
ce AS (SELECT b.doc_id, b.row_no, count(s.nll) AS n_valid, sum(s.nll) AS sum_nll FROM runs b LEFT JOIN s USING (doc_id, row_no) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (ORDER BY md5({seeded_key('shuf', str(SEED), '0', row_id)}), {row_id}) - 1 AS rk FROM ce),
m AS (SELECT (rk // 2) // 64 + 1 AS global_step, rk // 2 AS micro_step, sum(sum_nll) / sum(n_valid) AS micro_loss FROM r GROUP BY ALL)
SELECT global_step::BIGINT AS global_step, count(*)::BIGINT AS n_micro, round(avg(micro_loss), 6) AS mean_loss,
  round(arg_max(micro_loss, micro_step), 6) AS logged_loss FROM m GROUP BY global_step"""
    q["model_metrics"] = f"""WITH c AS ({q['model_comparison']})
SELECT metric, max(value) FILTER (model = 'unigram') AS unigram, max(value) FILTER (model = 'bigram') AS bigram
FROM (SELECT model, unnest(['ppl', 'eval_tokens', 'n_windows', 'model_entries']) AS metric,
  unnest([ppl, eval_tokens::DOUBLE, n_windows::DOUBLE, model_entries::DOUBLE]) AS value FROM c) GROUP BY metric"""
    return q


# ----------------------------------------------------------------- sequence twins
def _softplus(x: str) -> str:
    return f"(CASE WHEN ({x}) > 20 THEN ({x}) ELSE ln(1 + exp({x})) END)"


def _recursive(ab_sql: str, h0: str, out: str = "h") -> str:
    """Per-user sequential fold of h = a*h + b (twin of ``linear_recurrence``)."""
    return f"""WITH RECURSIVE e AS (
  SELECT user_id, event_id, a, b, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM ({ab_sql})
), r AS (
  SELECT user_id, event_id, rn, a * {h0} + b AS {out} FROM e WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.rn, e.a * r.{out} + e.b FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1
)"""


REC_AB = """SELECT user_id, event_id, ts, CASE WHEN event_type = 'error' THEN 0.0 ELSE least(value / 300.0, 1.0) END AS a,
  value / 7.0 AS b FROM events"""

_ALPHA = f"greatest(least({_softplus('0.0')} / ({_softplus('value / 50.0')} + 0.001), 1.0), 0.0)"
LIQUID_AB = f"SELECT user_id, event_id, ts, 1.0 - {_ALPHA} AS a, {_ALPHA} * tanh((value - 50.0) / 50.0) AS b FROM events"


def seq_oracles() -> dict[str, str]:
    q: dict[str, str] = {}
    q["linear_recurrence"] = _recursive(REC_AB, "1.0") + " SELECT user_id, event_id, round(h, 6) AS h FROM r"
    q["liquid_filter"] = _recursive(LIQUID_AB, "0.0") + " SELECT user_id, event_id, round(h, 6) AS h FROM r"
    q["final_state"] = (
        _recursive(LIQUID_AB, "0.0")
        + " SELECT user_id, count(*)::BIGINT AS n_rows, round(arg_max(h, rn), 6) AS h_final FROM r GROUP BY user_id"
    )
    q["trailing_mean"] = """SELECT user_id, event_id, round(m, 6) AS trailing_mean FROM (
  SELECT user_id, event_id,
    avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS m,
    count(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS n
  FROM events) WHERE n = 50"""
    q["causal_softmax_mean"] = """SELECT user_id, event_id, round(
    sum(exp(value / 100.0) * value) OVER w / sum(exp(value / 100.0)) OVER w, 6) AS attn
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
    q["causal_softmax_mean_large_scores"] = """WITH e AS (
  SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
t AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY rn) * 10.0 AS top FROM e)
SELECT i.user_id, i.event_id, round(sum(exp(j.value * 10.0 - i.top) * j.value) / sum(exp(j.value * 10.0 - i.top)), 6) AS attn
FROM t i JOIN e j ON i.user_id = j.user_id AND j.rn <= i.rn GROUP BY i.user_id, i.event_id"""
    q["history_attention"] = """WITH e AS (
  SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events
), pr AS (
  SELECT i.user_id, i.event_id, i.pos, (i.value / 100.0) * (j.value / 100.0) AS s, j.value AS v
  FROM e i JOIN e j ON i.user_id = j.user_id AND j.pos <= i.pos AND j.pos > i.pos - 1024
), m AS (SELECT *, max(s) OVER (PARTITION BY user_id, event_id) AS ms FROM pr)
SELECT user_id, event_id, pos::BIGINT AS pos, round(sum(exp(s - ms) * v) / sum(exp(s - ms)), 6) AS attn FROM m GROUP BY user_id, event_id, pos"""
    q["history_attention_vectors"] = """WITH e AS (
  SELECT label, vec_id, embedding::DOUBLE[] AS x, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos FROM embeddings
), pr AS (
  SELECT i.label, i.vec_id, i.pos, list_dot_product(i.x, j.x) / 8.0 AS s, j.x[1] AS v
  FROM e i JOIN e j ON i.label = j.label AND j.pos <= i.pos AND j.pos > i.pos - 1024
), m AS (SELECT *, max(s) OVER (PARTITION BY label, vec_id) AS ms FROM pr)
SELECT label, vec_id, pos::BIGINT AS pos, round(sum(exp(s - ms) * v) / sum(exp(s - ms)), 6) AS attn FROM m GROUP BY label, vec_id, pos"""
    alpha_x = f"greatest(least({_softplus('0.0')} / ({_softplus('x / 2.0')} + 0.001), 1.0), 0.0)"
    q["liquid_filter_vectors"] = f"""WITH RECURSIVE e AS (
  SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn,
    list_transform(embedding::DOUBLE[], lambda x: 1.0 - {alpha_x}) AS a,
    list_transform(embedding::DOUBLE[], lambda x: {alpha_x} * tanh(x)) AS b
  FROM embeddings
), r AS (
  SELECT label, vec_id, rn, list_transform(range(1, len(a) + 1), lambda i: a[i] * 0.0 + b[i]) AS h FROM e WHERE rn = 1
  UNION ALL
  SELECT e.label, e.vec_id, e.rn, list_transform(range(1, len(e.a) + 1), lambda i: e.a[i] * r.h[i] + e.b[i])
  FROM r JOIN e ON e.label = r.label AND e.rn = r.rn + 1
)
SELECT label, vec_id, round(list_sum(h), 6) AS h_sum, round(h[1], 6) AS h_first FROM r"""
    q["gate_functions"] = f"""SELECT event_id, round({_softplus('value / 50.0')}, 6) AS softplus,
  round(greatest(least(value / 100.0, 1.0), 0.0), 6) AS clamp, round(tanh((value - 50.0) / 50.0), 6) AS tanh,
  round(1.0 / (1.0 + exp(-((value - 50.0) / 50.0))), 6) AS sigmoid FROM events"""
    return q


# ----------------------------------------------------------------- vector & generation twins
GREEDY = f"""ustar AS (SELECT tok AS u, c AS uc FROM uni ORDER BY c DESC, tok LIMIT 1
), bp AS (
  SELECT big.ctx, big.nxt, 0.9::DOUBLE * big.c / cx.total + 0.1::DOUBLE * ((coalesce(uni.c, 0) + 1)::DOUBLE / (st.n + st.v)::DOUBLE) AS p
  FROM big JOIN cx USING (ctx) LEFT JOIN uni ON uni.tok = big.nxt CROSS JOIN st
), bb AS (
  SELECT ctx, nxt AS bn, p AS bpv, has_u FROM (
    SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY p DESC, nxt) AS r,
      max((nxt = (SELECT u FROM ustar))::INTEGER) OVER (PARTITION BY ctx) AS has_u FROM bp) WHERE r = 1
), pu AS (SELECT u, 0.1::DOUBLE * ((uc + 1)::DOUBLE / (st.n + st.v)::DOUBLE) AS p_u FROM ustar CROSS JOIN st
), g AS (
  SELECT ctx, CASE WHEN has_u = 1 OR bpv > p_u OR (bpv = p_u AND bn < u) THEN bn ELSE u END AS nxt,
    CASE WHEN has_u = 1 OR bpv > p_u OR (bpv = p_u AND bn < u) THEN bpv ELSE p_u END AS p
  FROM bb CROSS JOIN pu)"""


def gen_oracles() -> dict[str, str]:
    q: dict[str, str] = {}
    q["embedding_lookup"] = f"""WITH {DOC_TOKENS},
t AS (SELECT doc_id, unnest(tokens) AS token FROM doc_tok)
SELECT doc_id, count(*)::BIGINT AS n_tokens, round(sum(e.embedding[1]), 6) AS sum_first, round(sum(e.embedding[-1]), 6) AS sum_last,
  round(sum(list_sum(e.embedding::DOUBLE[])), 5) AS sum_all
FROM t JOIN embeddings e ON e.vec_id = t.token % (SELECT count(*) FROM embeddings) GROUP BY doc_id"""
    q["rms_norm"] = """WITH r AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)) / len(embedding) + 1e-5)) AS r
  FROM embeddings)
SELECT vec_id, round(list_sum(r), 6) AS rms_sum, round(sqrt(list_sum(list_transform(r, lambda x: x * x))), 6) AS rms_l2 FROM r"""
    q["dot"] = """SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""
    q["mips_topk"] = """SELECT query_id, rank, cand_id, round(score, 6) AS score FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS cand_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id)::BIGINT AS rank
  FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 20 = 0) WHERE rank <= 5"""
    q["greedy_next"] = f"WITH {MODEL}, {GREEDY} SELECT ctx, nxt AS next, round(p, 6) AS p FROM g"
    q["softmax_temperature"] = f"""WITH {MODEL},
z AS (SELECT ctx, nxt, ln(c) / 0.8 AS z FROM big),
e AS (SELECT ctx, nxt, exp(z - max(z) OVER (PARTITION BY ctx)) AS e FROM z)
SELECT ctx, nxt AS next, round(e / sum(e) OVER (PARTITION BY ctx), 6) AS prob FROM e"""
    u = f"(({u32(seeded_key('samp', str(SEED), 'ctx', 'nxt'))})::DOUBLE + 0.5) / 4294967296.0"
    q["temperature_sample"] = f"""WITH {MODEL}
SELECT ctx, arg_max(nxt, ln(c) / 0.8 - ln(-ln({u}))) AS sampled_next FROM big GROUP BY ctx"""
    q["temperature_sample_k"] = f"""WITH {MODEL}
SELECT ctx, draw, nxt AS next FROM (
  SELECT ctx, nxt, row_number() OVER (PARTITION BY ctx ORDER BY ln(c) / 0.8 - ln(-ln({u})) DESC, nxt)::BIGINT AS draw FROM big
) WHERE draw <= 4"""
    q["batch_generate_speed"] = f"""WITH RECURSIVE {MODEL}, {GREEDY},
pr AS (SELECT conv_id || '-' || turn AS prompt_id, {hashed_ids("'User: ' || coalesce(text, '') || chr(10) || 'Assistant: '")} AS t
  FROM conversations WHERE role = 'user'),
gen AS (
  SELECT prompt_id, len(t) AS n_prompt, 0 AS step, t[len(t)] AS last, []::INTEGER[] AS out FROM pr
  UNION ALL
  SELECT gen.prompt_id, gen.n_prompt, gen.step + 1, coalesce(g.nxt, pu.u)::INTEGER, list_append(gen.out, coalesce(g.nxt, pu.u)::INTEGER)
  FROM gen LEFT JOIN g ON g.ctx = gen.last CROSS JOIN pu
  WHERE gen.step < 100
)
SELECT prompt_id, any_value(n_prompt)::BIGINT AS n_prompt, len(arg_max(out, step))::BIGINT AS n_new, {arr_md5('arg_max(out, step)')} AS gen_md5
FROM gen GROUP BY prompt_id"""
    draw = f"(({u32(seeded_key('gen', str(SEED), 'gen.prompt_id', 'gen.step', 'nxt'))})::DOUBLE + 0.5) / 4294967296.0"
    q["batch_generate_sampled"] = f"""WITH RECURSIVE {MODEL},
ustar AS (SELECT tok AS u FROM uni ORDER BY c DESC, tok LIMIT 1),
pr AS (SELECT conv_id || '-' || turn AS prompt_id, {hashed_ids("'User: ' || coalesce(text, '') || chr(10) || 'Assistant: '")} AS t
  FROM conversations WHERE role = 'user'),
gen AS (
  SELECT prompt_id, len(t) AS n_prompt, 0 AS step, t[len(t)] AS last, []::INTEGER[] AS out FROM pr
  UNION ALL
  SELECT gen.prompt_id, gen.n_prompt, gen.step + 1, coalesce(p.nxt, (SELECT u FROM ustar))::INTEGER,
    list_append(gen.out, coalesce(p.nxt, (SELECT u FROM ustar))::INTEGER)
  FROM gen LEFT JOIN LATERAL (
    SELECT nxt FROM big WHERE big.ctx = gen.last ORDER BY ln(c) / 0.8 - ln(-ln({draw})) DESC, nxt LIMIT 1
  ) p ON true
  WHERE gen.step < 80 AND NOT list_contains(gen.out, {EOT})
)
SELECT prompt_id, any_value(n_prompt)::BIGINT AS n_prompt, len(arg_max(out, step))::BIGINT AS n_new, {arr_md5('arg_max(out, step)')} AS gen_md5
FROM gen GROUP BY prompt_id"""
    udraw = f"(({u32(seeded_key('cdf', str(SEED), 'gen.prompt_id', 'gen.step'))})::DOUBLE + 0.5) / 4294967296.0"
    q["batch_generate_sampled_cdf"] = f"""WITH RECURSIVE {MODEL},
ustar AS (SELECT tok AS u FROM uni ORDER BY c DESC, tok LIMIT 1),
cdf AS (
  SELECT ctx, nxt,
    coalesce(sum(pow(c::DOUBLE, 1.25)) OVER (PARTITION BY ctx ORDER BY nxt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)
      / sum(pow(c::DOUBLE, 1.25)) OVER (PARTITION BY ctx) AS lo
  FROM big
),
pr AS (SELECT conv_id || '-' || turn AS prompt_id, {hashed_ids("'User: ' || coalesce(text, '') || chr(10) || 'Assistant: '")} AS t
  FROM conversations WHERE role = 'user'),
gen AS (
  SELECT prompt_id, len(t) AS n_prompt, 0 AS step, t[len(t)] AS last, []::INTEGER[] AS out FROM pr
  UNION ALL
  SELECT gen.prompt_id, gen.n_prompt, gen.step + 1, coalesce(p.nxt, (SELECT u FROM ustar))::INTEGER,
    list_append(gen.out, coalesce(p.nxt, (SELECT u FROM ustar))::INTEGER)
  FROM gen LEFT JOIN LATERAL (
    SELECT nxt FROM cdf WHERE cdf.ctx = gen.last AND cdf.lo <= {udraw} ORDER BY cdf.lo DESC LIMIT 1
  ) p ON true
  WHERE gen.step < 80 AND NOT list_contains(gen.out, {EOT})
)
SELECT prompt_id, any_value(n_prompt)::BIGINT AS n_prompt, len(arg_max(out, step))::BIGINT AS n_new, {arr_md5('arg_max(out, step)')} AS gen_md5
FROM gen GROUP BY prompt_id"""
    train = MODEL[: MODEL.index("), tr AS")]
    chat_model = MODEL.replace(
        train, f"train AS (SELECT conv_id || '-' || turn AS doc_id, list_append({hashed_ids('text')}, {EOT}) AS t FROM conversations WHERE role = 'assistant'\n"
    )
    vdraw = f"(({u32(seeded_key('mixcdf', str(SEED), 'gen.prompt_id', 'gen.step'))})::DOUBLE + 0.5) / 4294967296.0"
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    q["batch_generate_interpolated"] = f"""WITH RECURSIVE {chat_model},
bw AS (SELECT tok, (c + 1)::DOUBLE / (n + v) AS q, pow(0.1 * ((c + 1)::DOUBLE / (n + v)), 1.25) AS w FROM uni CROSS JOIN st),
ucdf AS (SELECT tok, coalesce(sum(w) OVER (ORDER BY tok {before}), 0.0) / sum(w) OVER () AS lo FROM bw),
ut AS (SELECT sum(w) AS s FROM bw),
ex AS (SELECT big.ctx, nxt, pow(0.9 * big.c / cx.total + 0.1 * q, 1.25) - w AS e FROM big JOIN cx USING (ctx) JOIN bw ON bw.tok = big.nxt),
ecdf AS (SELECT ctx, nxt, coalesce(sum(e) OVER (PARTITION BY ctx ORDER BY nxt {before}), 0.0) / sum(e) OVER (PARTITION BY ctx) AS lo FROM ex),
et AS (SELECT ctx, sum(e) AS d FROM ex GROUP BY ctx),
pr AS (SELECT conv_id || '-' || turn AS prompt_id, {hashed_ids("'User: ' || coalesce(text, '') || chr(10) || 'Assistant: '")} AS t
  FROM conversations WHERE role = 'user'),
gen AS (
  SELECT prompt_id, len(t) AS n_prompt, 0 AS step, t[len(t)] AS last, []::INTEGER[] AS out FROM pr
  UNION ALL
  SELECT gen.prompt_id, gen.n_prompt, gen.step + 1, p.nxt::INTEGER, list_append(gen.out, p.nxt::INTEGER)
  FROM gen LEFT JOIN et ON et.ctx = gen.last CROSS JOIN ut JOIN LATERAL (
    (SELECT nxt FROM ecdf WHERE ecdf.ctx = gen.last AND {vdraw} * (s + d) < d AND ecdf.lo <= {vdraw} * (s + d) / d ORDER BY ecdf.lo DESC LIMIT 1)
    UNION ALL
    (SELECT tok AS nxt FROM ucdf WHERE {vdraw} * (s + coalesce(d, 0.0)) >= coalesce(d, 0.0)
       AND ucdf.lo <= ({vdraw} * (s + coalesce(d, 0.0)) - coalesce(d, 0.0)) / s ORDER BY ucdf.lo DESC LIMIT 1)
  ) p ON true
  WHERE gen.step < 80 AND NOT list_contains(gen.out, {EOT})
)
SELECT prompt_id, any_value(n_prompt)::BIGINT AS n_prompt, len(arg_max(out, step))::BIGINT AS n_new, {arr_md5('arg_max(out, step)')} AS gen_md5
FROM gen GROUP BY prompt_id"""
    q["batch_generate"] = f"""WITH RECURSIVE {MODEL}, {GREEDY},
pr AS (SELECT conv_id || '-' || turn AS prompt_id, {hashed_ids("'User: ' || coalesce(text, '') || chr(10) || 'Assistant: '")} AS t
  FROM conversations WHERE role = 'user'),
gen AS (
  SELECT prompt_id, len(t) AS n_prompt, 0 AS step, t[len(t)] AS last, []::INTEGER[] AS out FROM pr
  UNION ALL
  SELECT gen.prompt_id, gen.n_prompt, gen.step + 1, coalesce(g.nxt, pu.u)::INTEGER, list_append(gen.out, coalesce(g.nxt, pu.u)::INTEGER)
  FROM gen LEFT JOIN g ON g.ctx = gen.last CROSS JOIN pu
  WHERE gen.step < 80 AND NOT list_contains(gen.out, {EOT})
)
SELECT prompt_id, any_value(n_prompt)::BIGINT AS n_prompt, len(arg_max(out, step))::BIGINT AS n_new, {arr_md5('arg_max(out, step)')} AS gen_md5
FROM gen GROUP BY prompt_id"""
    return q


def misc_oracles(base: dict[str, str]) -> dict[str, str]:
    q: dict[str, str] = {}
    q["stream_prepare"] = base["corpus_training_rows"]
    q["stream_reordered"] = base["liquid_filter"].replace("round(h, 6) AS h FROM r", "round(h, 6) AS h, false AS late FROM r")
    q["stream_liquid_filter"] = base["liquid_filter"].replace("round(h, 6) AS h FROM r", "round(h, 6) AS h, false AS late FROM r")
    q["write_corpus_rows"] = f"""{CORPUS_ROWS.replace("FROM documents WHERE", f"FROM {BLANKED} WHERE")}
SELECT doc_id, {SHUF_KEY} AS shuffle_key, ({u32(seeded_key('shard', str(SEED), '0', 'doc_id'))} % 2)::INTEGER AS shard, crop_start::BIGINT AS crop_start,
  {arr_md5('input_ids')} AS ids_md5, {arr_md5('labels')} AS labels_md5 FROM built"""
    q["training_rows_sink"] = f"""{CORPUS_ROWS}
SELECT doc_id, ({u32(seeded_key('shard', str(SEED), '0', 'doc_id'))} % 2)::INTEGER AS shard, len(input_ids)::BIGINT AS row_len,
  {arr_md5('input_ids')} AS ids_md5, {arr_md5('labels')} AS labels_md5 FROM built"""
    left = []
    for epoch, stop in ((0, 3), (1, 1)):
        key = f"md5({seeded_key('shuf', str(SEED), str(epoch), 'doc_id')})"
        left.append(f"""SELECT {epoch}::INTEGER AS epoch, doc_id, shuffle_rank, global_step::BIGINT AS global_step FROM (
  SELECT doc_id, (row_number() OVER (ORDER BY {key}, doc_id) - 1)::BIGINT AS shuffle_rank FROM documents WHERE length(text) > 0)
  CROSS JOIN LATERAL (SELECT (shuffle_rank // 2) // 64 + 1 AS global_step) WHERE global_step > {stop}""")
    q["resume_remaining"] = " UNION ALL ".join(left)
    q["batch_score_python"] = f"""WITH {DOC_TOKENS},
w AS (SELECT doc_id, tokens, len(tokens) AS L, unnest(range(0, len(tokens), 512)) AS i FROM doc_tok),
c AS (SELECT doc_id, i, list_slice(tokens, greatest(i - 512, 0) + 1, least(i + 512, L)) AS x FROM w)
SELECT doc_id, i::BIGINT AS i, round(len(list_distinct(x)) / len(x), 6) AS distinct FROM c"""
    q["batch_score"] = f"""WITH {MODEL}, {DOC_TOKENS},
dtoks AS (SELECT doc_id, generate_subscripts(tokens, 1) - 1 AS pos, unnest(tokens) AS tok FROM doc_tok),
pr AS (SELECT doc_id, pos, lag(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS ctx, tok AS nxt FROM dtoks),
sc AS (SELECT * FROM {scored('(SELECT * FROM pr WHERE ctx IS NOT NULL)')}),
w AS (SELECT doc_id, len(tokens) AS L, unnest(range(0, len(tokens), 512)) AS i FROM doc_tok),
pw AS (SELECT doc_id, (pos // 512) * 512 AS i, avg(nll) AS m FROM sc GROUP BY ALL)
SELECT doc_id, i::BIGINT AS i, (least(i + 512, L) - i)::BIGINT AS trg_len, round(m, 6) AS mean_nll FROM w LEFT JOIN pw USING (doc_id, i)"""
    q["bpe_roundtrip"] = "SELECT doc_id, true AS roundtrip_ok FROM documents WHERE length(coalesce(text, '')) > 0"
    return q


def plan_oracles() -> dict[str, str]:
    q: dict[str, str] = {}
    parts = []
    for e in (0, 1):
        key = f"md5({seeded_key('shuf', str(SEED), str(e), 'conv_id')})"
        parts.append(
            f"SELECT conv_id, {e} AS epoch, (row_number() OVER (ORDER BY {key}, conv_id) - 1) AS shuffle_rank FROM c"
        )
    q["chat_batch_plan"] = f"""WITH c AS (SELECT DISTINCT conv_id FROM conversations),
n AS (SELECT (count(*) + 1) // 2 AS per_epoch FROM c),
r AS ({parts[0]} UNION ALL {parts[1]})
SELECT conv_id, epoch::BIGINT AS epoch, shuffle_rank::BIGINT AS shuffle_rank,
  (epoch * per_epoch + shuffle_rank // 2)::BIGINT AS micro_step,
  ((epoch * per_epoch + shuffle_rank // 2) // 16 + 1)::BIGINT AS global_step,
  ((per_epoch // 16) * 2)::BIGINT AS planned_steps
FROM r CROSS JOIN n"""
    q["corpus_training_plan"] = f"""{CORPUS_ROWS}
SELECT b.doc_id, r.shuffle_rank, ({u32(seeded_key('shard', str(SEED), '0', 'b.doc_id'))} % 2)::INTEGER AS shard,
  b.crop_start::BIGINT AS crop_start, {arr_md5('b.input_ids')} AS ids_md5, {arr_md5('b.labels')} AS labels_md5
FROM built b JOIN (SELECT doc_id, (row_number() OVER (ORDER BY {SHUF_KEY}, doc_id) - 1)::BIGINT AS shuffle_rank FROM doc_tok) r USING (doc_id)"""
    q["chat_packing_report"] = CHAT_CTE + f""",
a AS (
  SELECT count(*)::BIGINT AS n_rows, sum(least(total_tokens, 1024))::BIGINT AS n_tokens,
    sum(greatest(1024 - total_tokens, 0))::BIGINT AS n_pad, sum({count_valid('labels')})::BIGINT AS n_targets,
    sum((total_tokens > 1024)::INTEGER)::BIGINT AS n_cropped
  FROM padded
)
SELECT n_rows, n_tokens, n_pad, n_targets, n_cropped, (n_rows * 1024)::BIGINT AS token_budget,
  ((n_rows + 1) // 2)::BIGINT AS micro_steps, (((n_rows + 1) // 2) // 16)::BIGINT AS global_steps,
  round(n_pad / (n_rows * 1024), 6) AS pad_share, round(n_targets / (n_rows * 1024), 6) AS target_share
FROM a"""
    return q


HOT_EVENTS = "(SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS user_id) FROM events)"


def hot_oracles(base: dict[str, str]) -> dict[str, str]:
    """The same twins over the skewed derivation of ``events``."""
    q: dict[str, str] = {}
    hot_ab = REC_AB.replace("FROM events", f"FROM {HOT_EVENTS}")
    q["linear_recurrence_hot_key"] = _recursive(hot_ab, "1.0") + " SELECT user_id, event_id, round(h, 6) AS h FROM r"
    q["history_attention_hot_key"] = base["history_attention"].replace("FROM events", f"FROM {HOT_EVENTS}")
    q["trailing_mean_hot_key"] = base["trailing_mean"].replace("FROM events", f"FROM {HOT_EVENTS}")
    hot_conv = (
        "(SELECT CASE WHEN conv_id % 3 = 0 THEN 0 ELSE conv_id END AS conv_id, "
        "CASE WHEN conv_id % 3 = 0 THEN conv_id * 1000000000 + turn ELSE turn END AS turn, role, text FROM conversations)"
    )
    # a row with a null gate keeps the state: (a, b) = (1, 0); the recursion joins null users null-safely
    odd = "(SELECT * REPLACE (CASE WHEN user_id % 5 <> 0 THEN user_id + 9007199254740992 END AS user_id, CASE WHEN event_id % 11 <> 5 THEN value END AS value) FROM events)"
    for name, ab, h0 in (("linear_recurrence", REC_AB, "1.0"), ("liquid_filter", LIQUID_AB, "0.0")):
        kept = f"SELECT * REPLACE (CASE WHEN a IS NULL OR b IS NULL THEN 1.0 ELSE a END AS a, CASE WHEN a IS NULL OR b IS NULL THEN 0.0 ELSE b END AS b) FROM ({ab.replace('FROM events', f'FROM {odd}')})"
        q[f"{name}_odd_keys"] = _recursive(kept, h0).replace("e.user_id = r.user_id", "e.user_id IS NOT DISTINCT FROM r.user_id") + " SELECT coalesce(user_id::VARCHAR, 'none') AS user_key, event_id, round(h, 6) AS h FROM r"
    q["causal_softmax_mean_odd_keys"] = base["causal_softmax_mean"].replace("FROM events", f"FROM {odd}").replace("SELECT user_id,", "SELECT coalesce(user_id::VARCHAR, 'none') AS user_key,", 1)
    rep = "(SELECT * FROM conversations UNION ALL SELECT * FROM conversations WHERE conv_id % 3 = 0)"
    q["chat_training_rows_repeated"] = base["chat_training_rows"].replace("FROM conversations", f"FROM {rep}")
    q["chat_training_rows_hot_key"] = base["chat_training_rows"].replace("FROM conversations", f"FROM {hot_conv}", 1)
    return q
