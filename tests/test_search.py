"""Search semantics against SQLite FTS5 (Python's sqlite3) on hand-made rows."""

import random
import sqlite3

import pytest

from docs_helper import docs_frame
from folio.operators import analysis as A
from folio.operators import requests as R
from folio.operators.match import match_documents
from folio.plans.search import autocomplete, search

WORDS = ["alpha", "beta", "gamma", "delta", "query", "transaction", "embed", "json", "of", "the"]


def _corpus(n=120, seed=3):
    rng = random.Random(seed)
    types = ["function", "module", "extras", "callback", "task", "behaviour"]
    rows = []
    for i in range(1, n + 1):
        t = rng.choice(types)
        w1, w2 = rng.choice(WORDS), rng.choice(WORDS)
        title = {"function": f"Mod.{w1}_{w2}/1", "module": f"{w1.title()}.{w2.title()}",
                 "extras": f"{w1} {w2} - Guide", "callback": f"Mod.{w1}/2", "task": f"mix {w1}.{w2}",
                 "behaviour": f"{w1.title()}"}[t]
        doc = " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ","]) for _ in range(rng.randint(3, 40)))
        rows.append((i, rng.choice(["p1", "p2"]), t, title, doc))
    return rows


def _fts(rows, tokenizer="unicode61"):
    con = sqlite3.connect(":memory:")
    con.execute(f"create virtual table f using fts5(title, doc, tokenize='{tokenizer}')")
    return con


QUERIES = ["query", "alpha beta", "+alpha +beta", "alpha -beta", "gamma +delta", "+of -the", "tr*",
           "title:alpha", "doc:json", "alpha_beta", "the_of_the", "!", "! alpha", "+! alpha", "alpha -!",
           "embed +title:json", "json -title:query", "embeds", "transactions queries", "+embedding"]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = _corpus()
    d = docs_frame(spark, rows)
    idx = {r.id: r.ititle for r in A.indexable(d).select("id", "ititle").collect()}
    return rows, d, idx


def _sqlite_ids(rows, idx, package, q, stem=False):
    con = _fts(rows, "porter" if stem else "unicode61")
    for i, p, _t, _ti, doc in rows:
        if p == package:
            con.execute("insert into f(rowid, title, doc) values (?, ?, ?)", (i, idx[i], doc))
    expr = q
    try:
        return {r[0] for r in con.execute("select rowid from f where f match ?", (expr,))}
    except sqlite3.OperationalError:
        return set()


@pytest.mark.parametrize("stem", [False, True])
def test_match_agrees_with_fts5(spark, corpus, stem):
    rows, d, idx = corpus
    reqs_rows = [(i, q, "p1,p2") for i, q in enumerate(QUERIES)]
    reqs = R.requests_frame(spark, reqs_rows)
    canon = {r.request_id: r.expression for r in R.canonical_query(reqs).collect()}
    c = R.clauses(reqs)
    m = match_documents(A.postings(d, stem=stem), c, R.request_packages(reqs), R.request_meta(reqs, c), stem)
    got = {}
    for r in m.collect():
        got.setdefault((r.request_id, r.package), set()).add(r.id)
    for i, q in enumerate(QUERIES):
        for p in ("p1", "p2"):
            want = _sqlite_ids(rows, idx, p, canon[i], stem) if canon[i] else set()
            assert got.get((i, p), set()) == want, (q, canon[i], p)


def test_plus_equals_plain_and_not_only_removes(spark, corpus):
    _rows, d, _idx = corpus
    reqs = R.requests_frame(spark, [(1, "embed", "p1,p2"), (2, "+embed", "p1,p2"), (3, "embed -json", "p1,p2")])
    res = search(reqs, d, A.postings(d))
    by = {}
    for r in res.collect():
        by.setdefault(r.request_id, []).append((r.result_pos, r.id, r.rank))
    assert sorted(by.get(1, [])) == sorted(by.get(2, []))
    # Absent terms only ever remove documents from the matched set (before the top-25 cut).
    c = R.clauses(reqs)
    m = match_documents(A.postings(d), c, R.request_packages(reqs), R.request_meta(reqs, c))
    ids = {}
    for r in m.collect():
        ids.setdefault(r.request_id, set()).add((r.package, r.id))
    assert ids.get(3, set()) <= ids.get(1, set()) and ids.get(3) != ids.get(1)


def test_empty_cases(spark, corpus):
    _rows, d, _idx = corpus
    reqs = R.requests_frame(spark, [(1, "", "p1"), (2, "-embed", "p1"), (3, "embed", None), (4, "embed", "nope")])
    assert search(reqs, d, A.postings(d)).count() == 0
    assert autocomplete(reqs, d).count() == 0


def test_rank_order_and_top25(spark, corpus):
    _rows, d, _idx = corpus
    reqs = R.requests_frame(spark, [(1, "the of", "p1,p2,p1")])
    res = sorted(search(reqs, d, A.postings(d)).collect(), key=lambda r: r.result_pos)
    ranks = [r.rank for r in res]
    assert ranks == sorted(ranks, reverse=True)
    per_pkg = {}
    for r in res:
        per_pkg[r.package_pos] = per_pkg.get(r.package_pos, 0) + 1
    assert all(v <= 25 for v in per_pkg.values()) and len(per_pkg) == 3


def test_autocomplete_substring(spark):
    rows = [(1, "p", "module", "Ecto.Query", "x"), (2, "p", "module", "Café", "x"),
            (3, "p", "function", "Phoenix.disallow_upload/2", "x"), (4, "p", "module", "Other", "x")]
    d = docs_frame(spark, rows)
    reqs = R.requests_frame(spark, [(1, "QUERY", "p"), (2, "qu", "p"), (3, "cafe", "p"), (4, "CAFÉ", "p"),
                                    (5, "allow", "p"), (6, "qu*", "p"), (7, "doc:query", "p")])
    got = {}
    for r in autocomplete(reqs, d).collect():
        got.setdefault(r.request_id, set()).add(r.id)
    assert got == {1: {1}, 4: {2}, 5: {3}}


def test_bm25_golden(spark):
    from folio.operators.rank import bm25_words
    rows = [(1, "p", "extras", "alpha beta", "gamma delta alpha"), (2, "p", "extras", "beta", "beta beta gamma"),
            (3, "p", "extras", "delta", "alpha"), (4, "p", "extras", "eps zeta", "eta theta iota kappa"),
            (5, "p", "extras", "lam", "mu nu"), (6, "p", "extras", "xi", "omicron pi")]
    d = docs_frame(spark, rows)
    reqs = R.requests_frame(spark, [(1, "alpha beta", None)])
    c = R.clauses(reqs)
    got = {r.id: r.rank for r in bm25_words(A.postings(d), A.term_docs(d), A.row_lengths(d), c,
                                            R.request_meta(reqs, c)).collect()}
    want = {1: -1.267187326814922, 2: -0.915138622893761, 3: -0.730761799608040}
    assert set(got) == set(want)
    for k, v in want.items():
        assert abs(got[k] - v) < 1e-12


def test_requests_beyond_one_block(spark, corpus, monkeypatch):
    from folio.plans import search as S
    _rows, d, _idx = corpus
    reqs = R.requests_frame(spark, [(i, q, "p1,p2") for i, q in enumerate(QUERIES)])
    cols = ["request_id", "result_pos", "id"]
    whole = sorted(search(reqs, d, A.postings(d)).select(*cols).collect())
    monkeypatch.setattr(S, "BROADCAST_ROW_LIMIT", 60)
    assert len(S.request_blocks(reqs)) > 2
    assert sorted(search(reqs, d, A.postings(d)).select(*cols).collect()) == whole


def test_spelling_against_all_pairs(spark):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(120)})
    vocab = [(w, rng.randrange(2, 9)) for w in words[::2]]
    got = A.spell_candidates(spark.createDataFrame([(w,) for w in words[1::2]], "word string"),
                             spark.createDataFrame(vocab, "term string, doc bigint"), top_k=3).collect()
    want = []
    for w in words[1::2]:
        near = sorted((edits(w, v), -n, v) for v, n in vocab if edits(w, v) <= 2)[:3]
        want += [(w, v, -n, e, k) for k, (e, n, v) in enumerate(near, 1)]
    assert sorted((r.word, r.term, r.doc, r.distance, r.rk) for r in got) == sorted(want)
