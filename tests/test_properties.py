"""Property checks (hypothesis) of the pure numeric kernels and window arithmetic."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from textkiln.operators.sequence import segmented_scan


@settings(max_examples=200, deadline=None)
@given(
    st.lists(
        st.tuples(st.integers(0, 3), st.sampled_from([0.0, 1.0, 0.5, -0.7, 2.0]), st.floats(-5, 5)),
        min_size=1,
        max_size=80,
    )
)
def test_segmented_scan_equals_loop(rows):
    rows = sorted(rows, key=lambda r: r[0])
    seg = np.array([r[0] for r in rows])
    a = np.array([r[1] for r in rows])
    b = np.array([r[2] for r in rows])
    A, B = segmented_scan(seg, a, b)
    h, last = None, None
    for i, (k, ai, bi) in enumerate(rows):
        if k != last:
            h, last, hA = 0.0, k, 1.0
        h = ai * h + bi
        hA = ai * hA
        assert abs(B[i] - h) < 1e-9 * max(1.0, abs(h))
        assert abs(A[i] - hA) < 1e-9 * max(1.0, abs(hA))


def _windows(L, stride=512, max_len=1024):
    out = []
    for i in range(0, L, stride):
        begin, end = max(i + stride - max_len, 0), min(i + stride, L)
        out.append((i, begin, end, end - i))
    return out


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 6000))
def test_window_targets_partition_positions(L):
    w = _windows(L)
    assert sum(t for *_, t in w) == L
    targets = [p for i, b, e, _ in w for p in range(max(i, b + 1), e)]
    assert targets == list(range(1, L))  # every position but the first is a target exactly once
    assert all(p // 512 * 512 == i for i, b, e, _ in w for p in range(max(i, 1), e))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tab.'c1é", max_size=12), min_size=1, max_size=8), st.integers(1, 60))
def test_piece_rule_matches_whole_text_split(texts, limit):
    """Cutting the joined text after every visible character that precedes
    whitespace never changes the pre-token split (pure-Python check of the rule
    ``whitespace_pieces`` relies on)."""
    import regex

    from textkiln.constants import BPE_PATTERN

    pat = regex.compile(BPE_PATTERN)
    s = "\n\n".join(texts)[:limit]
    cuts = [0] + [i + 1 for i in range(len(s) - 1) if not s[i].isspace() and s[i + 1].isspace()] + [len(s)]
    pieces = [s[a:b] for a, b in zip(cuts, cuts[1:]) if b > a]
    assert [m for p in pieces for m in pat.findall(p)] == pat.findall(s)
