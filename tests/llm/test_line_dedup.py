import random

import numpy as np

from folio.llm.cuckoo import Chain
from folio.llm.line_dedup import LineIndex
from llm_helpers import frame

WS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WS))


def brute(rows, index_rows=None):
    """Texts of ``rows`` after dedup against the documents ``index_rows``."""
    holders = {}
    for i, t in index_rows or rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        keep = []
        for line in (t or "").split("\n"):
            ids = holders.get(key(line), set())
            owner = min((x for x in ids if x is not None), default=None)
            keep.append(not (len(ids) >= 2 and i != owner))
        lines = (t or "").split("\n")
        left = "\n".join(x for x, k in zip(lines, keep, strict=True) if k)
        out.append((i, t if all(keep) else left, len(lines), keep.count(False)))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "", r[2:]))


def answer(index, df, indexed=False):
    out = index.dedup(df, counts=("n_lines", "n_dropped"), indexed=indexed)
    assert out.columns == [*df.columns, "n_lines", "n_dropped"]
    return order((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect())


def corpus(seed, n=80):
    rng = random.Random(seed)
    pool = [f"Shared line number {i} of the pool" for i in range(30)] + ["short", "  Shared LINE number 3 of the pool\t", ""]
    return [(i, "\n".join(rng.choice(pool) if rng.random() < .5 else f"own line {i} {j} text" for j in range(rng.randrange(1, 9))))
            for i in rng.sample(range(1000), n)]


def test_against_brute_force(spark):
    rows = corpus(1)
    df = frame(spark, rows)
    index = LineIndex.create(spark, shards=3).insert(df)
    assert answer(index, df) == answer(index, df, indexed=True) == order(brute(rows))


def test_insert_and_delete_are_reversible(spark):
    first, second = corpus(1), [(i + 2000 if i % 2 else -i - 1, t) for i, t in corpus(2)]
    a, b = frame(spark, first), frame(spark, second)
    one = LineIndex.create(spark, shards=3).insert(a)
    both = one.insert(b)
    assert answer(both, b) == order(brute(second, first + second))
    assert answer(both, a) == order(brute(first, first + second))
    back = both.delete(b.select("doc_id"))
    assert answer(back, a) == order(brute(first))
    assert answer(one, a) == order(brute(first))  # a former version still answers
    assert sorted(back.refs().collect()) == sorted(one.refs().collect())
    again = LineIndex.open(spark, back.folder)
    assert again.versions == back.versions and answer(again, a) == order(brute(first))
    gone = back.delete(a.select("doc_id"))
    assert gone.refs().count() == 0 and answer(gone, a) == order(brute(first, [(0, "")]))


def test_odd_rows(spark, odd, empty):
    df, rows = odd
    pairs = [(r[0], r[1]) for r in rows]
    index = LineIndex.create(spark, shards=2).insert(df)
    assert answer(index, df) == answer(index, df, indexed=True) == order(brute(pairs))
    assert answer(LineIndex.create(spark, shards=2).insert(empty), empty) == []
    assert answer(LineIndex.create(spark, shards=2), df) == order(brute(pairs, [(0, "")]))


def test_cuckoo_chain_loses_nothing():
    rng = np.random.default_rng(1)
    hi, lo = rng.integers(-2**63, 2**63, (2, 50_000))
    chain = Chain()
    for part in np.array_split(np.arange(50_000), 7):
        chain.put(hi[part], lo[part])
    chain.put(hi[:20_000], lo[:20_000])
    assert (chain.copies(hi, lo) >= np.where(np.arange(50_000) < 20_000, 2, 1)).all()
    other_hi, other_lo = rng.integers(-2**63, 2**63, (2, 20_000))
    assert (chain.copies(other_hi, other_lo) > 0).mean() < 0.01
    chain = Chain(chain.blobs())
    chain.take(hi[:20_000], lo[:20_000])
    assert (chain.copies(hi, lo) >= 1).all() and (chain.copies(hi, lo) > 1).mean() < 0.01
    chain.take(hi, lo)
    assert not any(f.any() for f in chain.filters)
    same = np.zeros(30, np.int64)
    chain.put(same, same)  # more copies of one key than its two buckets hold
    assert (chain.copies(same, same) == 30).all()


def test_keys_of_ascii_and_other_lines(spark):
    from folio.llm.common import ascii_lower
    from pyspark.sql import functions as F

    texts = ["", "ABC Xyz", "ÄB c", "İI ß", "Ⅳ Ⓐ A", "名A", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    lower = {chr(c): chr(c + 32) for c in range(65, 91)}
    want = [None if t is None else "".join(lower.get(x, x) for x in t) for t in texts]
    assert [r.k for r in rows.select(ascii_lower(F.col("t")).alias("k")).collect()] == want
    plan = rows.select(ascii_lower(F.col("t")).alias("k"))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "octet_length" in plan  # plain text is not searched
