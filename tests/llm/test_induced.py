import numpy as np
import pytest

from latticework.llm._induced import RangeMinima, Spill, suffix_array


def slow(text, cap):
    t = text.tolist()
    sa = sorted(range(len(t)), key=lambda i: t[i:])
    lcp = [0]
    for a, b in zip(sa, sa[1:]):
        k = 0
        while a + k < len(t) and b + k < len(t) and t[a + k] == t[b + k]:
            k += 1
        lcp.append(min(k, cap))
    return sa, lcp


@pytest.mark.parametrize("memory", [1, 50, 10**6])
def test_equals_sorting(tmp_path, memory):
    rng = np.random.default_rng(memory)
    for size in (1, 2, 3, 5, 10, 40, 300):
        for letters in (1, 2, 3, 30, 400):
            for cap in (3, 1000):
                text = np.append(rng.integers(1, letters + 1, size - 1), 0)
                spill = Spill(str(tmp_path))
                sa, lcp = suffix_array(text, cap, spill, memory)
                spill.close()
                assert (sa.tolist(), lcp.tolist()) == slow(text, cap)


def test_repetitive_texts(tmp_path):
    for text in ([1] * 200, [1, 2] * 100, [2, 1] * 77, [1, 1, 2] * 60, [3, 2, 1] * 50, [5] * 50 + [4] * 50 + [5] * 49, [1, 2, 3, 4, 5, 6, 7, 8] * 30):
        text = np.array([*text, 0])
        sa, lcp = suffix_array(text, 60, Spill(str(tmp_path)), 20)
        assert (sa.tolist(), lcp.tolist()) == slow(text, 60)


def test_many_ranges_and_spills(tmp_path):
    rng = np.random.default_rng(1)
    words = rng.zipf(1.3, 30000) % 20000 + 1
    text = np.concatenate([words, words[5000:9000], words[:300], [0]])
    spill = Spill(str(tmp_path))
    sa, lcp = suffix_array(text, 50, spill, 1500)
    assert spill.made > 4
    spill.close()
    assert list(tmp_path.iterdir()) == []
    assert sorted(sa.tolist()) == list(range(len(text)))
    t = text.tolist()
    for k in range(1, len(sa)):
        a, b, n = sa[k - 1], sa[k], 0
        while n < 50 and max(a, b) + n < len(t) and t[a + n] == t[b + n]:
            n += 1
        assert n == lcp[k]
        if n < 50:
            assert t[a + n] < t[b + n]


def test_range_minima():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 200, 3000)
    r = RangeMinima(3000, np.uint8)
    for part in np.array_split(x, [1, 2, 40, 500, 501, 2000]):
        r.append(part)
        a = rng.integers(0, r.n, 300)
        b = rng.integers(0, r.n, 300)
        a, b = np.minimum(a, b), np.maximum(a, b)
        assert (r.query(a, b) == [x[i : j + 1].min() for i, j in zip(a, b)]).all()
