import numpy as np
import pyarrow as pa

from textkiln.llm import common as C


def test_slices_are_bounded_by_rows_and_bytes():
    texts = pa.array(["x" * n if n is not None else None for n in [10] * 600 + [5 << 20, 5 << 20, 9 << 20, None, 1, 0] + [3 << 20] * 7])
    cuts = list(C._slices(texts))
    assert [a for a, _ in cuts] == [0, *np.cumsum([n for _, n in cuts])[:-1]] and sum(n for _, n in cuts) == len(texts)
    for a, n in cuts:
        size = sum(len(x.as_py() or "") for x in texts[a : a + n])
        assert n <= C.SLICE_ROWS and (size <= C.SLICE_BYTES or n == 1)
    assert list(C._slices(pa.array([], pa.string()))) == []


def test_token_table_starts_anew_without_changing_values():
    table = C.TokenTable(lambda tokens: np.array([float(len(t)) for t in tokens]), limit=3)
    for texts in ([["a", "bb", "a"], []], [["ccc", "dddd", "bb"]], [[], ["a", "eeeee"]], [["eeeee"]]):
        ids, sizes, rows = table.look_up(texts)
        assert rows[ids].tolist() == [float(len(t)) for x in texts for t in x]
        assert C.segment_sums(rows[ids], sizes).tolist() == [float(sum(map(len, x))) for x in texts]
