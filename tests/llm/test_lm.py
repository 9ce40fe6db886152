import math
from collections import Counter, defaultdict

import pytest

from folio.llm import lm as L
from llm_helpers import frame, prose


class Brute:
    """The model of the module's docstring, by dictionaries."""

    def __init__(self, texts):
        self.docs = [L.tokens(t) for t in texts]
        self.words = Counter(w for d in self.docs for w in d)
        self.n, self.v = sum(self.words.values()), len(self.words)
        self.pairs = Counter(p for d in self.docs for p in zip([None, *d], d))
        exact = Counter(self.pairs.values())
        self.d = L.discounts([exact[k] for k in (1, 2, 3, 4)])
        self.follows = Counter(w for _, w in self.pairs)
        kinds = Counter(self.follows.values())
        self.d1 = L.discounts([kinds[k] for k in (1, 2, 3, 4)])
        self.ctx = defaultdict(Counter)
        for (u, w), c in self.pairs.items():
            self.ctx[u][w] = c
        cut = lambda d, k: [0, *d][min(k, 3)]
        self.rest = sum(cut(self.d1, k) for k in self.follows.values()) / len(self.pairs) if self.pairs else 1
        self.of = {u: (sum(c.values()), sum(cut(self.d, k) for k in c.values())) for u, c in self.ctx.items()}

    def base(self, w):
        cut = lambda k: [0, *self.d1][min(k, 3)]
        rest = self.rest
        k = self.follows[w]
        return (max(k - cut(k), 0) / len(self.pairs) if self.pairs else 0) + rest / (self.v + 1)

    def p(self, u, w):
        if u not in self.ctx:
            return self.base(w)
        cut = lambda k: [0, *self.d][min(k, 3)]
        total, rest = self.of[u]
        return max(self.ctx[u][w] - cut(self.ctx[u][w]), 0) / total + rest / total * self.base(w)

    def score(self, text):
        t = L.tokens(text)
        return (len(t), sum(self.words[w] > 0 for w in t),
                sum(math.log10((self.words[w] + .5) / (self.n + .5 * (self.v + 1))) for w in t),
                sum(math.log10(self.p(u, w)) for u, w in zip([None, *t], t)))


TRAIN = [prose(i, 80).replace("w" + "a", "the") for i in range(40)] + ["the cat sat", "The cat ran", "the the the", "", None]


@pytest.mark.parametrize("shards", [1, 7])
def test_against_brute_force(spark, shards):
    texts = [" ".join(t.split()[i:] + t.split()[:i]) if t else t for i, t in enumerate(TRAIN)] + TRAIN
    brute = Brute(texts)
    model = L.train(frame(spark, list(enumerate(texts))), shards=shards)
    assert (model.tokens, model.words, model.pairs) == (brute.n, brute.v, len(brute.pairs))
    tests = [*TRAIN[:10], "the cat flew", "unknown words only", "", None, "THE\tcat\r\nsat", "the " * 50]
    for r in L.score(frame(spark, list(enumerate(tests))), model).collect():
        n, known, base, score = brute.score(tests[r.doc_id])
        assert (r.n_tokens, r.n_known) == (n, known)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)
        assert r.perplexity == pytest.approx(10 ** (-score / n), rel=1e-9)


def test_probabilities_add_up_to_one(spark):
    import numpy as np

    model = L.train(frame(spark, list(enumerate(TRAIN))), shards=3)
    look = L.Lookup(model)
    every = np.arange(-1, model.words)  # all words, and the unknown one
    assert look.base(every).sum() == pytest.approx(1)
    for u in [*range(0, model.words, 97), model.words, -1]:
        assert look.probability(np.full(len(every), u), every).sum() == pytest.approx(1)


def test_better_than_the_base_on_held_out_texts(spark):
    from folio.llm.queries import op7_lm_score

    rows = op7_lm_score(spark, "/root/testdata/sf0.1").where("held_out").collect()
    assert len(rows) > 1000
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_odd_rows(spark, odd, empty):
    df, rows = odd
    model = L.train(df, shards=2)
    brute = Brute([r[1] for r in rows])
    got = sorted(((r.doc_id is None, r.doc_id, r.n_tokens, r.n_known, round(r.score, 6)) for r in L.score(df, model).collect()), key=str)
    want = sorted(((r[0] is None, r[0], s[0], s[1], round(s[3], 6)) for r in rows for s in [brute.score(r[1])]), key=str)
    assert got == want
    nothing = L.train(empty, shards=2)
    assert nothing.words == nothing.tokens == 0
    assert {r.doc_id: (r.score, r.n_known) for r in L.score(frame(spark, [(1, "a b"), (2, None)]), nothing).collect()} == {1: (0, 0), 2: (0, 0)}
    assert L.score(empty, model).collect() == []


def test_few_counts_give_plain_discounts():
    assert L.discounts([1, 0, 0, 0]) == [.5, 1, 1.5]
    d = L.discounts([100, 40, 20, 10])
    assert all(0 < x <= k + 1 for k, x in enumerate(d))
