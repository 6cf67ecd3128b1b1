"""DuckDB twins of the registered queries that SQL can express."""

from __future__ import annotations

from textkiln.llm import license_scan as lic
from textkiln.llm import merkle_manifest as man
from textkiln.llm import poisson_mix as mix
from textkiln.llm import repetition as rep
from textkiln.plans.sqlparts import lit, seeded_key, u32

_WORD = r"[^\x20\x09-\x0D]+"


def _windows(size: int) -> str:
    """Positions covered by windows of ``size`` words that recur in their text (``u``: rid, i, word)."""
    words = " || ' ' || ".join(["word"] + [f"lead(word, {k}) OVER r" for k in range(1, size)])
    return f"""
      SELECT DISTINCT rid, unnest(range(i, i + {size})) AS p FROM (
        SELECT rid, i, count(*) OVER (PARTITION BY rid, ws) AS times
        FROM (SELECT rid, i, {words} AS ws FROM u WINDOW r AS (PARTITION BY rid ORDER BY i)) WHERE ws IS NOT NULL)
      WHERE times > 1"""


OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, ws, len(ws) AS n FROM (SELECT rid, regexp_extract_all(text, '{_WORD}') AS ws FROM d)),
u AS (SELECT rid, unnest(range(1, n + 1)) AS i, unnest(ws) AS word FROM w),
three AS (SELECT rid, count(*) AS c FROM ({_windows(rep.WINDOW)}) GROUP BY rid),
wide AS (SELECT rid, count(*) AS c FROM ({_windows(rep.MIN_REPEAT)}) GROUP BY rid),
-- a repeat of more than MAX_REPEAT words is a window of MAX_REPEAT + 1 words that recurs; its words are covered
far AS (SELECT DISTINCT rid FROM (
  SELECT rid, count(*) OVER (PARTITION BY rid, array_to_string(ws[i:i + {rep.MAX_REPEAT}], ' ')) AS times
  FROM (SELECT rid, ws, unnest(range(1, n - {rep.MAX_REPEAT - 1})) AS i FROM w JOIN wide USING (rid) WHERE c > {rep.MAX_REPEAT}))
  WHERE times > 1),
l AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d),
m AS (
  SELECT d.rid, doc_id, w.n AS n_words,
    coalesce(list_sum(list_transform(w.ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(three.c, 0) AS n_repeat_words, coalesce(wide.c, 0) AS covered_words, far.rid IS NOT NULL AS far
  FROM d JOIN w USING (rid) JOIN l USING (rid) LEFT JOIN three USING (rid) LEFT JOIN wide USING (rid) LEFT JOIN far USING (rid)),
b AS (SELECT *, n_words < {rep.MIN_WORDS} OR 100 * n_repeat_words > {rep.MAX_WINDOW_SHARE} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, base_failed,
  NOT base_failed AND 100 * covered_words <= {rep.MAX_COVERED} * n_words AND NOT far AS kept
FROM b
"""


OP8 = f"""
WITH s AS (SELECT source, sum(coalesce(strlen(text), 0) + 1)::DOUBLE AS b FROM documents GROUP BY source),
r AS (SELECT source, pow(b, {mix.POWER}) / sum(pow(b, {mix.POWER})) OVER () * {mix.EPOCHS} * sum(b) OVER () / b AS rate FROM s),
p AS (SELECT source, greatest(ceil(rate / {mix.LARGEST_MEAN}), 1)::INTEGER AS parts, rate / greatest(ceil(rate / {mix.LARGEST_MEAN}), 1) AS mean FROM r),
c AS (
  SELECT source, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM (SELECT *, unnest(range(0, ceil(mean + 12 * sqrt(mean) + 24)::INTEGER + 1)) AS k FROM p)),
d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(doc_id::VARCHAR, 't' || md5(coalesce(text, ''))) AS key FROM documents),
u AS (
  SELECT rid, source, ({u32(seeded_key("mix", str(mix.SEED), "key", "j"))} + 0.5) / 4294967296.0 AS u
  FROM (SELECT rid, d.source, key, unnest(range(1, parts + 1)) AS j FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)),
n AS (SELECT rid, count(c.k) AS n FROM u LEFT JOIN c ON u.source IS NOT DISTINCT FROM c.source AND c.cdf < u.u GROUP BY rid),
x AS (SELECT doc_id, source, key, unnest(range(0, n))::INTEGER AS copy FROM d JOIN n USING (rid))
SELECT doc_id, source, copy, substr(md5({seeded_key("order", str(mix.SEED), "key", "copy")}), 1, 16) AS shuffle_key FROM x
"""


OP1 = """
WITH t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, c) AS pos FROM (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, md5(coalesce(role, '') || chr(31) || coalesce(text, '')) AS c FROM conversations)),
l AS (SELECT conv_id, list(c ORDER BY pos) AS cs FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT cs[1:k] AS pre FROM (SELECT cs, unnest(range(1, len(cs))) AS k FROM l)),
m AS (SELECT min(conv_id) AS conv_id, len(cs) AS n_turns FROM l ANTI JOIN p ON l.cs = p.pre GROUP BY cs)
SELECT t.conv_id, turn, pos, n_turns, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered
FROM t JOIN m ON t.conv_id IS NOT DISTINCT FROM m.conv_id
"""



def _list(values) -> str:
    return "[" + ", ".join(_list(v) if isinstance(v, list) else lit(v) for v in values) + "]"


_TEMPLATES = ", ".join(
    f"({i}, {lit(name)}, {lit(text)}, {_list(needs)}::VARCHAR[][], {_list(bars)}::VARCHAR[], {weak})"
    for i, ((name, text), (needs, bars, weak)) in enumerate(zip(lic.TEMPLATES, lic.rules(), strict=True))
)

OP4 = f"""
WITH f AS (
  SELECT doc_id, text, concat_ws('/', source, 'p' || (doc_id // 5000)) AS above, 'd' || (doc_id // 500) AS d,
    (doc_id // 20) % 25 = 0 AS licence, (doc_id // 500) % 10 = 0 AS tenth FROM documents),
files AS (
  SELECT doc_id, text, CASE WHEN licence AND tenth THEN above || '/LICENSE' WHEN licence THEN above || '/' || d || '/LICENSE'
    ELSE above || '/' || d || '/' || doc_id || '.txt' END AS path FROM f),
given AS (SELECT row_number() OVER () AS rid, doc_id, path, text FROM files WHERE text IS NOT NULL),
direct AS (
  SELECT rid, unnest(list_distinct(list_concat(
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {lit(lic.MARKER)})),
    CASE WHEN regexp_matches(regexp_extract(path, '[^/]*$'), {lit(lic.LICENCE_FILE)}) THEN [text] ELSE [] END))) AS text
  FROM given),
speaks AS (SELECT text FROM direct WHERE regexp_matches(text, {lit(lic.MARKER)})),
-- header blocks: runs of adjacent lines of one kind, without comment signs
ll AS (SELECT rid, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT rid, string_split_regex(text, '\\r\\n|[\\r\\n\\f]') AS ls FROM given)),
kinds AS (
  SELECT *, CASE WHEN NOT regexp_matches(line, '[A-Za-z0-9]') THEN 0 WHEN regexp_matches(line, {lit(lic.OPENER)}) THEN NULL
    WHEN regexp_matches(line, {lit(lic.COMMENT)}) THEN 1 ELSE 2 END AS kind FROM ll),
cuts AS (SELECT *, coalesce(kind <> lag(kind) OVER (PARTITION BY rid ORDER BY i), false) AS cut FROM kinds),
runs AS (
  SELECT rid, string_agg(regexp_replace(line, {lit(lic.LEAD)}, ''), ' ' ORDER BY i) AS text
  FROM (SELECT *, sum(cut::INTEGER) OVER (PARTITION BY rid ORDER BY i) AS run FROM cuts) GROUP BY rid, run),
sentences AS (SELECT rid, unnest(string_split(regexp_replace(text, '([.!?])[ \\t]+', '\\1' || chr(12), 'g'), chr(12))) AS text FROM runs),
found AS (
  SELECT DISTINCT rid, md5(text) AS block, text FROM (SELECT * FROM direct UNION ALL SELECT * FROM runs UNION ALL SELECT * FROM sentences)),
blocks AS (SELECT block, any_value(text) AS text FROM found GROUP BY block),
tpl(template, license, text, needs, bars, weak) AS (VALUES {_TEMPLATES}),
bt AS (SELECT block, term, 1 + ln(count(*)) AS tf FROM (SELECT block, unnest(regexp_extract_all(lower(text), {lit(lic.TERM)})) AS term FROM blocks) GROUP BY ALL),
tt AS (SELECT template, term, 1 + ln(count(*)) AS tf FROM (SELECT template, unnest(regexp_extract_all(lower(text), {lit(lic.TERM)})) AS term FROM tpl) GROUP BY ALL),
total AS (SELECT (SELECT count(*) FROM speaks) + (SELECT count(*) FROM tpl) AS t),
idf AS (
  SELECT term, ln((1 + any_value(t)) / (1 + count(*))) + 1 AS idf
  FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), {lit(lic.TERM)}))) AS term FROM speaks UNION ALL SELECT term FROM tt), total GROUP BY term),
w AS (SELECT block, bt.term, tf * coalesce(idf, ln(1 + t) + 1) AS w FROM bt LEFT JOIN idf USING (term), total),
v AS (SELECT template, term, tf * idf AS v FROM tt JOIN idf USING (term)),
scored AS (
  SELECT block, template, round(sum(w * v) / (any_value(bn) * any_value(tn)), 6) AS score, any_value(told) AS told
  FROM w JOIN v USING (term) JOIN (SELECT template, sqrt(sum(v * v)) AS tn FROM v GROUP BY template) USING (template)
  JOIN (SELECT block, sqrt(sum(w * w)) AS bn, list(term) AS told FROM w GROUP BY block) USING (block)
  GROUP BY block, template HAVING score >= {lic.LEAST_COSINE}),
best AS (
  SELECT block, license, weak, score FROM scored JOIN tpl USING (template)
  WHERE len(list_filter(needs, lambda n: NOT list_has_any(n, told))) = 0 AND NOT list_has_any(bars, told)
  QUALIFY row_number() OVER (PARTITION BY block ORDER BY weak, score DESC, license) = 1),
own AS (
  SELECT doc_id, path, license, weak, score FROM found JOIN best USING (block) JOIN given USING (rid)
  QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY weak, score DESC, license) = 1),
declared AS (
  SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, license FROM own WHERE regexp_matches(regexp_extract(path, '[^/]*$'), {lit(lic.LICENCE_FILE)})
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY weak, score DESC, license) = 1),
inherited AS (
  SELECT files.doc_id, files.path, declared.dir, declared.license FROM files JOIN declared
    ON declared.dir = '' OR starts_with(regexp_replace(files.path, '/?[^/]*$', '') || '/', declared.dir || '/')
  QUALIFY row_number() OVER (PARTITION BY files.doc_id, files.path ORDER BY length(declared.dir) DESC) = 1)
SELECT files.doc_id, files.path, own.license AS own_license, own.score AS own_score, coalesce(own.license, inherited.license) AS license,
  CASE WHEN own.license IS NOT NULL THEN 'own' ELSE inherited.dir END AS licensed_by
FROM files LEFT JOIN own USING (doc_id, path) LEFT JOIN inherited USING (doc_id, path)
"""


def _record(html: str) -> str:
    head = "'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: '"
    end = "chr(13) || chr(10) || chr(13) || chr(10)"
    return f"({head} || strlen(coalesce({html}, '')) || {end} || coalesce({html}, '') || {end})"


OP10 = f"""
WITH r AS (
  SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS archive, strlen({_record("html")}) AS length, {u32(seeded_key("damage", "page_id"))} AS damage,
    sha256({_record("html")}) AS digest_a, sha256({_record("('~' || substring(html, 2))")}) AS bad FROM pages),
o AS (SELECT *, sum(length) OVER (PARTITION BY archive ORDER BY page_id NULLS FIRST, digest_a ROWS UNBOUNDED PRECEDING) - length AS pos FROM r)
SELECT archive, pos::BIGINT AS "offset", page_id AS record_id, CASE WHEN damage % 131 = 1 THEN 'missing' ELSE 'altered' END AS status,
  digest_a, CASE WHEN damage % 131 = 1 THEN NULL ELSE bad END AS digest_b
FROM o WHERE damage % 131 = 1 OR (damage % 97 = 0 AND bad <> digest_a)
"""


OP11 = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.n, a.vec_id AS anchor_id, a.label, c.n AS cn, c.vec_id AS id, c.label AS c_label, list_dot_product(a.q, c.q)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.n <> c.n),
p AS (
  SELECT n, anchor_id, label, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY n ORDER BY score DESC, id) AS k
  FROM s WHERE label = c_label),
g AS (
  SELECT p.anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY p.n, k ORDER BY score DESC, id) AS rank
  FROM p JOIN s ON p.n = s.n AND s.label <> c_label AND k <= 5 AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM g WHERE rank <= 5
"""


def crc32_text(value: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit (the reflected polynomial 0xEDB88320)."""
    bits = f"flatten(list_transform(range(1, len({value}) + 1), lambda i: [ascii(({value})[i])::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    step = "xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))"
    return f"xor(list_reduce({bits}, lambda c, e: {step}, 4294967295::BIGINT), 4294967295)"


def _levels(first: str, name: str, count: int) -> str:
    """CTEs of the nodes above ``first`` (g, pos, total, h), the siblings on each level, and what each group comes down to."""
    fan, out = man.FANOUT, []
    for k in range(count):
        below = first if k == 0 else f"{name}{k}"
        out.append(f"{name}{k + 1} AS (SELECT g, divide(pos, {fan}) AS pos, divide(any_value(total) + {fan - 1}, {fan}) AS total, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM {below} WHERE total > 1 GROUP BY g, divide(pos, {fan}))")
        sides = ", ".join(f"coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos {op} a.pos), '') AS {side}" for op, side in (("<", "l"), (">", "r")))
        out.append(f"{name}s{k} AS (SELECT a.g, a.pos, {sides} FROM {below} a JOIN {below} b ON a.g IS NOT DISTINCT FROM b.g AND divide(a.pos, {fan}) = divide(b.pos, {fan}) WHERE a.total > 1 GROUP BY a.g, a.pos)")
    tops = " UNION ALL ".join(f"SELECT g, h FROM {x} WHERE total = 1" for x in [first, *(f"{name}{k + 1}" for k in range(count))])
    return ",\n".join([*out, f"{name}top AS ({tops})"])


def _climb(start: str, name: str, count: int, group: str, at: str) -> str:
    """CTEs that fold ``f`` and gather ``proof`` of every row of ``start`` through the levels of ``name``."""
    out = []
    for k in range(count):
        below = start if k == 0 else f"{name}w{k}"
        out.append(
            f"{name}w{k + 1} AS (SELECT w.* REPLACE (CASE WHEN s.l IS NULL THEN f ELSE sha256(s.l || f || s.r) END AS f, proof || coalesce(s.l || s.r, '') AS proof) "
            f"FROM {below} w LEFT JOIN {name}s{k} s ON w.{group} IS NOT DISTINCT FROM s.g AND divide(w.{at}, {man.FANOUT**k}) = s.pos)"
        )
    return ",\n".join(out)


def _leaf(text: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


#: Levels that the twin of op13 unrolls: 8^7 documents a language, 8^4 languages.
_ROWS_UP, _GROUPS_UP = 7, 4
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP13 = f"""
WITH d AS (
  SELECT doc_id, lang AS g, {_leaf("text")} AS leaf,
    CASE WHEN {crc32_text("doc_id::VARCHAR")} % 3 = 0 THEN {_leaf(_LOWERED)} ELSE {_leaf("text")} END AS shown FROM documents),
a0 AS (SELECT *, leaf AS h, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS total FROM d),
{_levels("a0", "a", _ROWS_UP)},
b0 AS (SELECT 0 AS g, g AS lang, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS total FROM atop),
{_levels("b0", "b", _GROUPS_UP)},
w0 AS (
  SELECT a0.doc_id, leaf, a0.g, a0.pos, b0.h AS subroot, b0.g AS top, b0.pos AS top_pos, btop.h AS root, shown AS f, '' AS proof
  FROM a0 JOIN b0 ON a0.g IS NOT DISTINCT FROM b0.lang JOIN btop ON true),
{_climb("w0", "a", _ROWS_UP, "g", "pos")},
{_climb(f"aw{_ROWS_UP}", "b", _GROUPS_UP, "top", "top_pos")}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM bw{_GROUPS_UP}
"""


def oracles() -> dict[str, str]:
    return {"op1_chat_snapshots": OP1, "op4_license_scan": OP4, "op10_merkle_audit": OP10, "op8_poisson_mixing": OP8, "op6_quality_repetition": OP6, "op11_hard_negatives": OP11, "op13_merkle_manifest": OP13}
