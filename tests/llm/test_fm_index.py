import numpy as np

from brindle.llm.fm_index import Bits, FMIndex, WaveletTree, suffix_array


def test_suffix_array():
    draw = np.random.default_rng(0)
    for n, symbols in ((1, 2), (50, 2), (300, 3), (300, 200)):
        text = np.append(draw.integers(1, symbols + 1, n), 0)
        bits = int(symbols).bit_length()
        assert list(suffix_array(text, bits)) == sorted(range(n + 1), key=lambda i: tuple(text[i:]))
    same = np.append(np.ones(500, dtype=np.int64), 0)
    assert list(suffix_array(same, 1)) == list(range(500, -1, -1))


def test_ranks():
    draw = np.random.default_rng(1)
    flags = draw.random(1000) < 0.3
    assert list(Bits(flags).rank(np.arange(1001))) == [0, *np.cumsum(flags)]
    text = draw.integers(0, 11, 500)
    tree = WaveletTree(text, 4)
    for c in range(12):
        assert list(tree.rank(np.full(501, c), np.arange(501))) == [0, *np.cumsum(text == c)]
    symbol, before = tree.access(np.arange(500))
    assert (symbol == text).all() and list(before) == [int((text[:i] == text[i]).sum()) for i in range(500)]


def test_search_and_locate():
    draw = np.random.default_rng(2)
    text = draw.integers(1, 5, 600)
    index = FMIndex(text, 5)
    for length in (1, 2, 4, 7):
        patterns = np.array([text[i : i + length] for i in range(0, 500, 7)] + [draw.integers(1, 6, length) for _ in range(20)])
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high):
            expected = [i for i in range(len(text) - length + 1) if (text[i : i + length] == p).all()]
            assert sorted(index.locate(np.arange(a, b))) == expected
