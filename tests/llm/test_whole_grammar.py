"""Re-Pair to the end: long repeats shrink to a few symbols, rare pairs are replaced too."""

import numpy as np

from oreflow.llm import token_output


def test_long_and_rare_repeats():
    rng = np.random.default_rng(1)
    passage, rare = rng.integers(0, 50_000, 50), rng.integers(0, 50_000, 8)
    parts = [np.r_[passage, rng.integers(0, 50_000, 30)] for _ in range(300)] + [np.r_[rare, rng.integers(0, 50_000, 30)] for _ in range(6)]
    ids = np.concatenate(parts).astype(np.uint32)
    ends = np.zeros(len(ids), bool)
    ends[np.cumsum([len(x) for x in parts]) - 1] = True
    symbols, last, rules, lengths = token_output.compress(ids, ends, 50_000)
    assert (token_output.expand(symbols, 50_000, rules, lengths) == ids).all() and last.sum() == len(parts)
    assert lengths.max() >= 50 and 8 in lengths
    assert len(symbols) <= 300 * 32 + 6 * 32


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(2)
    for kinds in (1, 2, 30, 4000):
        ids = rng.zipf(1.3, 20_000) % kinds
        ends = rng.random(len(ids)) < 0.01
        ends[-1] = True
        symbols, last, rules, lengths = token_output.compress(ids.astype(np.uint32), ends, 50_000)
        assert (token_output.expand(symbols, 50_000, rules, lengths) == ids).all() and last.sum() == ends.sum()
        left: dict[tuple[int, int], int] = {}
        before = None  # the place of the pair that was counted last
        for k in range(len(symbols) - 1):
            pair = (int(symbols[k]), int(symbols[k + 1]))
            if last[k] or before == (k - 1, pair):
                continue
            left[pair] = left.get(pair, 0) + 1
            before = (k, pair)
        assert max(left.values(), default=0) < token_output.MIN_COUNT
        assert len(symbols) + 3 * len(rules) <= len(ids)
