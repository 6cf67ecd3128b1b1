import math

from pyspark.sql import functions as F

from textkiln.operators import evaluation
from textkiln.plans import heldout


def test_window_counts_and_weights(spark):
    lens = [0, 1, 512, 513, 1024, 1025]
    df = spark.createDataFrame([(i, L) for i, L in enumerate(lens)], "seq long, L long")
    w = evaluation.sliding_windows(df, ["seq"]).groupBy("seq").agg(F.count("*").alias("n"), F.sum("trg_len").alias("s")).collect()
    got = {r.seq: (r.n, r.s) for r in w}
    assert got == {1: (1, 1), 2: (1, 512), 3: (2, 513), 4: (2, 1024), 5: (3, 1025)}


def _loop_ppl(nll, L, stride=512, max_len=1024):
    """The strided evaluation loop, with nll[p] the loss of predicting position p."""
    total = 0.0
    for i in range(0, L, stride):
        begin, end = max(i + stride - max_len, 0), min(i + stride, L)
        trg = end - i
        targets = [p for p in range(max(i, begin + 1), end)]
        if not targets:
            return None
        total += sum(nll[p] for p in targets) / len(targets) * trg
    return math.exp(total / L)


def test_perplexity_matches_window_loop(spark):
    rows, lens = [], []
    for seq, L in enumerate([1, 2, 511, 512, 513, 1024, 1025, 1537]):
        lens.append((seq, L))
        rows += [(seq, p, 0.5 + (p * 7 % 13) / 10.0) for p in range(1, L)]
    scored = spark.createDataFrame(rows, "seq long, pos long, nll double")
    lengths = spark.createDataFrame(lens, "seq long, L long")
    got = {r.seq: r.ppl for r in evaluation.sliding_perplexity(scored, lengths, ["seq"]).collect()}
    for seq, L in lens:
        nll = {p: 0.5 + (p * 7 % 13) / 10.0 for p in range(1, L)}
        want = _loop_ppl(nll, L)
        assert (got[seq] is None and want is None) or abs(got[seq] - want) < 1e-9 * want


def test_window_membership_counts(spark):
    L = 1300
    pos = spark.createDataFrame([(0, p, L) for p in range(L)], "seq long, pos long, L long")
    m = evaluation.window_membership(pos, ["seq"]).groupBy("i", "role").count().collect()
    got = {(r.i, r.role): r["count"] for r in m}
    assert got[(0, "target")] == 511 and got[(0, "context")] == 1
    assert got[(512, "target")] == 512 and got[(512, "context")] == 512
    assert got[(1024, "target")] == 276 and got[(1024, "context")] == 512


def test_joined_corpus_tokens_equal_whole_text(spark, enc):
    texts = ["  lead", "trail  ", "", "   ", "mid dle", " x\n", "\n\n", "end"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")
    joined = "\n\n".join(texts)
    for limit in (10_000, 17, 25):
        pieces = heldout.heldout_pieces(df, tokenizer="bpe", limit=limit)
        got = [t for r in pieces.orderBy("piece").collect() for t in r.tokens]
        assert got == enc.encode_ordinary(joined[:limit])
        offs = [r.tok_offset for r in pieces.orderBy("piece").collect()]
        assert offs == sorted(offs) and offs[0] == 0


def test_masked_cross_entropy_null_without_targets(spark):
    train = spark.createDataFrame([(0, [1, 2, 3, 2, 3])], "doc_id long, tokens array<int>")
    m = evaluation.ngram_fit(train)
    rows = spark.createDataFrame(
        [(0, [1, 2, 3], [-100, 2, 3]), (1, [1, 2], [-100, -100])], "doc_id long, input_ids array<int>, labels array<int>"
    )
    got = {r.doc_id: r for r in evaluation.masked_cross_entropy(rows, m, ["doc_id"]).collect()}
    assert got[1].mean_nll is None and got[1].n_valid == 0 and got[0].n_valid == 2
    # N = 5, V = 3 + 1; c(2) = c(3) = 2, so q(2) = q(3) = 3/9
    # p(2|1) = 0.9 * 1/1 + 0.1 * 3/9; p(3|2) = 0.9 * 2/2 + 0.1 * 3/9
    want = -(math.log(0.9 + 0.1 * 3 / 9) + math.log(0.9 + 0.1 * 3 / 9)) / 2
    assert abs(got[0].mean_nll - want) < 1e-12


def test_batch_score_runs_any_scorer_over_window_inputs(spark):
    toks = list(range(1, 1300))
    seqs = spark.createDataFrame([(7, toks)], "doc_id long, tokens array<int>")
    w = evaluation.window_inputs(seqs, ["doc_id"])

    def scorer(pdf):
        return pdf.assign(n_in=pdf["input_chunk"].map(len), first=pdf["input_chunk"].map(lambda a: int(a[0])))[
            ["doc_id", "i", "trg_len", "n_in", "first"]
        ]

    out = {r.i: r for r in evaluation.batch_score(w, scorer, "doc_id long, i long, trg_len long, n_in long, first long").collect()}
    assert sorted(out) == [0, 512, 1024]
    assert (out[0].n_in, out[0].first) == (512, 1)
    assert (out[512].n_in, out[512].first) == (1024, 1)
    assert (out[1024].n_in, out[1024].first, out[1024].trg_len) == (787, 513, 275)


def test_joined_corpus_hashed_pieces_match_whole_text(spark):
    import hashlib

    import regex

    from textkiln.constants import EOT, PIECE_PATTERN

    texts = ["  lead in", "trail \t ", "", " \n ", "mid dle's 42!", "\n\n", "end  "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")
    joined = "\n\n".join(texts)
    pat = regex.compile(PIECE_PATTERN, flags=regex.ASCII)  # ASCII \\s, Unicode \\p{L}: as Java and RE2

    def ids(s):
        return [int(hashlib.md5(p.encode()).hexdigest()[:8], 16) % EOT for p in pat.findall(s)]

    for limit in (10_000, 23, 31):
        pieces = heldout.heldout_pieces(df, tokenizer="hashed", limit=limit)
        got = [t for r in pieces.orderBy("piece").collect() for t in r.tokens]
        assert got == ids(joined[:limit])


def test_pairs_are_built_once(spark):
    from textkiln.operators import evaluation

    rows = spark.createDataFrame([(1, [5, 6, 7], [5, -100, 7]), (2, [5], [5]), (3, None, None)], "k long, input_ids array<int>, labels array<int>")
    made = {"label": evaluation.label_pairs(rows, ["k"]), "next": evaluation.next_token_pairs(rows, ["k"], "input_ids")}
    assert [tuple(r) for r in made["label"].collect()] == [(1, 6, 7)]
    assert [tuple(r) for r in made["next"].collect()] == [(1, 1, 5, 6), (1, 2, 6, 7)]
    for df in made.values():  # no inferred filter builds them a second time
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("arrays_zip(") == 1 and "zip_with" not in plan
