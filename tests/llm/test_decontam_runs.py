"""Comparison of texts with items at many beginnings at once."""

import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cellweave.llm.decontam import equal_runs

words_ = st.lists(st.integers(0, 2), max_size=12)


def slow(text, items, wanted, window):
    out = set()
    for i, at in wanted:
        own, need, run = items[i], min(window, len(items[i])), None
        for k in range(len(own) + 1):
            same = k < len(own) and 0 <= at + k < len(text) and own[k] == text[at + k]
            if same and run is None:
                run = k
            if not same and run is not None:
                if k - run >= need:
                    out.add((i, at + run, at + k))
                run = None
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(words_, st.lists(words_.filter(len), min_size=1, max_size=3), st.data(), st.sampled_from([1, 7, 1 << 20]))
def test_runs_equal_the_plain_comparison(text, items, data, most):
    wanted = data.draw(st.lists(st.tuples(st.integers(0, len(items) - 1), st.integers(-14, 14)), max_size=20))
    begin = np.cumsum([0, *map(len, items)])
    item, at = (np.array([w[x] for w in wanted], np.int64) for x in (0, 1))
    got = equal_runs(np.array(text, np.uint64), np.array(sum(items, []), np.uint64), begin, item, at, 3, most)
    assert [tuple(map(int, r)) for r in got.T] == slow(text, items, wanted, 3)


def test_a_text_of_one_word_is_compared_in_bounded_parts():
    n, size = 200_000, 100
    began = time.time()
    got = equal_runs(np.ones(n, np.uint64), np.ones(size, np.uint64), np.array([0, size]), np.zeros(n, np.int64), np.arange(n), 10)
    assert got.shape == (3, n - 9) and (got[2] - got[1] == np.minimum(size, n - got[1])).all()
    assert time.time() - began < 30
