import random

import numpy as np
import pytest
import xxhash

from folio.llm import simhash as S
from llm_helpers import frame, prose


def brute_fingerprint(text, k=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ")
             .replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows, bits=3):
    fps = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None)
             for g in set(group)}
    return [(r[0], f, least[g]) for r, f, g in zip(rows, fps, group, strict=True)]


@pytest.mark.parametrize("bits", range(7))
def test_every_pair_within_the_distance_meets(bits):
    rng = np.random.default_rng(bits)
    x = rng.integers(0, 2**63, 500, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 500, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, bits, replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    met = np.zeros(len(x), bool)
    for first, size in S.blocks_for(bits):
        rx, ax, hx = S.anchors(x, first, size)
        ry, ay, _ = S.anchors(y, first, size)
        home = np.zeros(len(x), np.uint64)
        home[rx[hx]] = ax[hx]
        met[ry[ay == home[ry]]] = True
    assert met.all()


def test_components_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        words = prose(i, 200).split(" ")
        for _ in range(rng.choice([1, 1, 3])):
            near = list(words)
            near[rng.randrange(len(near))] = "changed"
            rows.append((len(rows) * 7 % 200, " ".join(near)))
    rows += [(500, rows[0][1]), (501, rows[0][1]), (502, ""), (503, None)]
    got = S.simhash_components(frame(spark, rows)).collect()
    want = brute_components(rows)
    assert sorted((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got) == sorted(want)
    assert len({c for _, _, c in want}) < len(want)


def test_links_between_fingerprints_alone(spark):
    """A dense family (all within few bits) and chains, against union-find over all pairs."""
    rng = random.Random(3)
    base = rng.getrandbits(63)
    fps = {base ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for _ in range(300)}
    fps |= {rng.getrandbits(63) for _ in range(200)}
    chain = rng.getrandbits(62)
    for b in range(0, 60, 3):
        chain ^= 7 << b
        fps.add(chain)
    fps = sorted(fps)
    group = {f: f for f in fps}

    def root(f):
        while group[f] != f:
            f = group[f]
        return f
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                group[y] = x
    got = S.families(spark.createDataFrame([(f,) for f in fps], "fp bigint"), 3).collect()
    assert {r.fp: r.family for r in got} == {f: root(f) for f in fps}


def test_odd_rows(spark, odd, empty):
    df, rows = odd
    got = S.simhash_components(df).collect()
    want = brute_components([(r[0], r[1]) for r in rows])
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got), key=key) == sorted(want, key=key)
    assert S.simhash_components(empty).collect() == []


def test_one_of_each_group_stays(spark, odd, empty):
    df, rows = odd
    kept = S.keep_one_per_group(df)
    assert kept.columns == df.columns
    got = kept.collect()
    # 2 twice: two texts have that id, and neither is near the other.
    assert sorted(r.doc_id for r in got) == [1, 2, 2, 3, 6, 8, 9]
    assert {r.text for r in got} == {prose(1), prose(2), prose(3), None, rows[9][1], rows[11][1], rows[12][1]}
    assert S.keep_one_per_group(empty).collect() == []
    alone = S.keep_one_per_group(frame(spark, [(None, "a b c d"), (None, "a b c d")])).collect()
    assert [(r.doc_id, r.text) for r in alone] == [(None, "a b c d")]
