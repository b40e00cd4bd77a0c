"""What op8 exchanges: replies once, longer contexts only behind candidates."""

import numpy as np
from test_queries import table

from vapora.llm import suffix_tree_lm as S


def test_distinct_of_numbers_that_low_bits_tell_apart():
    x = np.random.default_rng(1).integers(0, 50, 2000).astype(np.uint64) + (np.random.default_rng(2).integers(0, 3, 2000).astype(np.uint64) << np.uint64(60))
    for some in (x, x[:1], x[:0]):
        found, at, where = S.distinct(some)
        assert (found == np.unique(some)).all() and (some[at] == found).all() and (found[where] == some).all()


def test_replies_are_not_shuffled_again(spark):
    scores = S.suffix_tree_scores(table(spark, [(k, f"a b c d e {k % 3} f g", "en") for k in range(40)]), least=2, gain=1.0)
    assert scores.count() == 40
    assert "Exchange" not in scores._jdf.queryExecution().executedPlan().toString()


def test_longer_contexts_are_asked_for_behind_candidates_alone():
    """The pairs a b and b c are frequent, the three words a b c are not, so nothing is asked of what follows them."""
    rule, n = (4, 20, 5.0), 8
    tokens = S.Tokens(np.arange(n), np.arange(1, n + 1, dtype=np.uint64) << np.uint64(40), np.array([n]), np.array([False]), 10_000, rule)
    tokens.counts, tokens.owned = [np.full(n, 900), np.full(n, 200)], [np.zeros(n, bool)] * 2
    asked = tokens.asked()
    assert [d for d, _ in asked] == [2] and len(asked[0][1]) == n - 2
    tokens.learn(np.full(n - 2, 4 * 5))
    assert sum(len(at) for _, at in tokens.asked()) == 0
