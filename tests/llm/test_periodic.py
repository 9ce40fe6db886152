import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import periodic as P
from folio.llm.queries import QUERIES
from folio.llm.suffix_tree import RangeMin, SuffixTree


def brute(w, least=12):
    """(start, length, period) of every run, from all periods."""
    n, out = len(w), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q) and not any(
                    all(w[x] == w[x + r] for x in range(i, j + q - r)) for r in range(1, q)):
                out.add((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


@pytest.mark.parametrize("least", [2, 4, 12])
def test_runs_of_small_alphabets(least):
    rng = random.Random(least)
    for _ in range(1500):
        n = rng.randint(0, 60)
        w = [rng.randrange(rng.choice([1, 2, 2, 3, 4])) for _ in range(n)]
        if n and rng.random() < 0.5:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 2))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        words = [b"%d" % x for x in w]
        got = P.find_runs([words, words[::-1], [], words + words], least)
        assert [list(map(tuple, g.tolist())) for g in got] == [brute(x, least) for x in (w, w[::-1], [], w + w)]


def test_fibonacci_and_repeated_words():
    a, b = "a", "ab"
    while len(b) < 300:
        a, b = b, b + a
    assert list(map(tuple, P.runs_of(np.array([ord(c) for c in b]), 2).tolist())) == brute(b, 2)
    assert P.runs_of(np.zeros(50, int)).tolist() == [[0, 50, 1]]


def test_extensions_and_ranks():
    rng = np.random.default_rng(5)
    for k in (1, 2, 5):
        s = rng.integers(1, k + 1, 90)
        tree = SuffixTree(s, k)
        ranks = tree.tour()
        suffixes = [[*s[i:].tolist(), 0] for i in range(91)]
        assert np.argsort(ranks).tolist() == sorted(range(91), key=lambda i: suffixes[i])
        assert np.argsort(tree.ranks_reversed()).tolist() == sorted(range(91), key=lambda i: [-x if x else -99 for x in suffixes[i]])
        i, j = np.divmod(np.arange(90 * 90), 90)
        i, j = i[i != j], j[i != j]
        want = [next((d for d in range(91) if suffixes[x][d:d + 1] != suffixes[y][d:d + 1]), 0) for x, y in zip(i, j, strict=True)]
        assert tree.extension(i, j).tolist() == want


def test_range_minima():
    v = np.random.default_rng(1).integers(0, 1000, 3000).astype(np.int32)
    r, pairs = RangeMin(v), np.random.default_rng(2).integers(0, 3000, (4000, 2))
    assert r.query(*pairs.T).tolist() == [v[min(a, b):max(a, b) + 1].min() for a, b in pairs]


def test_sieve_loses_no_run_and_leaves_prose_alone():
    rng = random.Random(3)
    prose = [b"%d" % rng.randrange(300) for _ in range(5000)]
    assert not list(P.stretches(np.array([int(x) for x in prose]), np.zeros(5000, int)))
    quoted = prose[:40] + prose[40:] + prose[:40]  # a repeat, but far apart
    assert [len(r) for r in P.find_runs([quoted])] == [0]
    held = prose[:100] + prose[:30] * 3 + prose[200:220]
    assert list(map(tuple, P.find_runs([held])[0].tolist())) == brute(held)


def test_odd_rows(spark, odd):
    df, rows = odd
    rows = [(r[0], r[1]) for r in rows] + [(20, "a " * 40), (21, "x y z " * 9 + "end"), (22, "1\t2\n1\r2\x0b1\x0c2 " * 5),
                                           (23, "a b   " * 15)]
    df = spark.createDataFrame(rows, "id bigint, text string").withColumn("runs", F.lit(1)).withColumn("n_words", F.lit(2))
    got = df.select("id", "text", P.periodic_runs(F.col("text")).alias("p")).collect()
    assert len(got) == len(rows)
    for r in got:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        assert r.p.n_words == len(w)
        if len(w) < 500:
            assert [tuple(x) for x in r.p.runs] == brute(w)
        assert r.p.collapsed == collapsed(w, [tuple(x) for x in r.p.runs])


def test_long_text_is_one_run(spark):
    text = " ".join(f"w{i % 7000}" for i in range(60_000))
    r = spark.createDataFrame([(text,)], "text string").select(P.periodic_runs(F.col("text")).alias("p")).first().p
    assert [tuple(x) for x in r.runs] == [(0, 60_000, 7000)] and len(r.collapsed.split()) == 7000


def test_empty_table(spark, empty):
    assert empty.select(P.periodic_runs(F.col("text")).alias("p")).collect() == []


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op12_periodic_runs"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    some = 0
    for r in got:
        w = planted(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or ""))
        if len(w) > 2500:
            continue
        runs = brute(w)
        some += len(runs) > 0
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert (r.n_runs, r.exponent_milli) == (len(runs), best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
    assert some > 10
