import random

import pytest

from folio.llm import substring_dedup as S
from llm_helpers import frame, prose


def brute(rows, run=3, min_words=12):
    """(id, text) -> removed sentence numbers, by comparing runs as tuples of words."""
    ends = S._Ends()
    first, places = {}, []
    docs = {(i is None, i, t) for i, t in rows if t}
    import xxhash  # noqa: F401  the order among texts of one id is by hash: ids with two texts are left to the caller
    for null, i, t in sorted(docs, key=lambda d: (d[0], d[1] or 0)):
        flat = [s for line in S.sentences(t, ends) for s in line]
        for at in range(len(flat) - run + 1):
            words = flat[at:at + run]
            if sum(map(len, words)) >= min_words:
                k = tuple(" ".join(s).lower() for s in words)
                first.setdefault(k, (i, t, at))
                places.append((k, (i, t, at)))
    gone = {}
    for k, (i, t, at) in places:
        if first[k] != (i, t, at):
            gone.setdefault((i, t), set()).update(range(at, at + run))
    return [(i, sorted(gone[i, t]) if (i, t) in gone else None) for i, t in rows]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, str(r[1])))


def passage(seed):
    return prose(seed, 55).replace("\n", " ")


def test_against_brute_force(spark):
    rng = random.Random(6)
    shared = [passage(5000 + i) for i in range(6)]
    rows = []
    for i in range(60):
        w = prose(i, 80).split(" ")
        for p in rng.sample(shared, rng.choice([0, 0, 1, 2])):
            w.insert(rng.randrange(len(w)), p)
        rows.append((i * 13 % 101, " ".join(w)))
    rows += [(300, rows[0][1]), (301, passage(5000) + " " + passage(5000)), (302, "No. So. Yes. No. So. Yes. No. So. Yes.")]
    got = S.dedup(frame(spark, rows)).collect()
    want = order(brute(rows))
    assert order((r.doc_id, sorted(r.removed_sentences) if r.removed_sentences else None) for r in got) == want
    assert any(g for _, g in want) and any(g is None for _, g in want)


def test_repeated_passages_go_and_the_rest_stays(spark):
    """A passage of over 50 words, put in at any word of clean texts, stays once."""
    p = passage(9000)
    rows = []
    for i in range(12):
        w = prose(100 + i, 150).split(" ")
        w.insert(7 * i + 3, p)
        rows.append((i, " ".join(w)))
    rows.append((50, prose(700)))
    got = {r.doc_id: r for r in S.dedup(frame(spark, rows)).collect()}
    core = p.split(" ")[20:30]
    assert got[0].text == rows[0][1] and got[50].text == rows[-1][1]
    for i in range(1, 12):
        assert " ".join(core) not in got[i].text
        before = prose(100 + i, 150).replace("\n", " ").split(" ")
        left = got[i].text.replace("\n", " ").split(" ")
        assert len(left) >= len(before) - 30 and set(left) <= set(before) | set(p.split(" "))


def test_removal_keeps_the_other_lines():
    ends = {}
    class By(dict):
        def __missing__(self, w):
            return w.endswith(".")
    assert S.remove("A b. C d. E.\n  F  g.\n\nH.", {1}, By()) == ("A b. E.\n  F  g.\n\nH.", 5)
    assert S.remove("A b.\nC d.\nE", {1}, By()) == ("A b.\nE", 3)
    assert S.remove("A b.", {0}, By()) == ("", 1)
    assert not ends


def test_odd_rows(spark, odd, empty):
    df, rows = odd
    out = S.dedup(df)
    assert out.columns == [*df.columns, "removed_sentences"]
    got = out.collect()
    assert len(got) == len(rows)
    pairs = [(r[0], r[1]) for r in rows]
    want = [(i, S.remove(t, set(gone), S._Ends())[0] if gone else t) for (i, t), (_, gone) in zip(pairs, brute(pairs), strict=True)]
    assert order((r.doc_id, r.text) for r in got) == order(want)
    left = {r.doc_id: r.text for r in got}
    assert left[1] == prose(1) and left[3] is None and left[4] == "" and left[5] == " \n\t " and left[6] == prose(99, 30_000)
    assert len(left[7]) < 0.1 * len(left[6]) and len(left[10]) < 0.5 * len(left[1])
    assert S.dedup(empty).collect() == []


def spans(words, n=50):
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def test_every_shared_span_of_50_words_holds_a_run():
    """Against a brute force on words: passages of every kind at random places of two texts."""
    rng = random.Random(31)
    word = lambda: "v" + "".join(rng.choice("abcdefghij") for _ in range(4))
    kinds = [lambda i: word() + (".\n" if i % 9 == 8 else " "), lambda i: word() + " ", lambda i: word() + "\n",
             lambda i: word() + (". " if i % 2 else " "), lambda i: word() + ("\n" if i % 3 == 2 else " "),
             lambda i: chr(rng.randrange(0x4E00, 0x9000)), lambda i: chr(rng.randrange(0x0E01, 0x0E2E)),
             lambda i: rng.choice(["row", "cell", "tab", "end."]) + rng.choice(" \n")]
    ends, held = S._Ends(), 0
    for k in range(4000):
        passage = "".join(map(kinds[k % len(kinds)], range(50))).strip()
        texts = []
        for _ in range(2):
            glue = "" if k % len(kinds) in (5, 6) else rng.choice([" ", "\n"])
            around = ["".join(map(kinds[rng.choice([k % len(kinds), 0])], range(rng.randrange(30)))) for _ in range(2)]
            texts.append(around[0] + glue + passage + glue + around[1])
        one, two = ([w for line in S.sentences(t, ends) for s in line for w in s] for t in texts)
        if spans(one) & spans(two):
            held += 1
            a, b = (set(S.run_hashes(t, ends, 3, 12, True)[1].tolist()) for t in texts)
            assert a & b, texts
            a, b = (set(S.run_hashes(t, ends, 3, 20, True)[1].tolist()) for t in texts)
            assert a & b, texts
    assert held > 3900


def test_short_lines_and_text_without_blanks_are_removed(spark):
    menu = "\n".join(f"Dish{i} {i}" for i in range(40))
    chinese = "".join(chr(0x4E00 + i * 37 % 5000) + ("\u3002" if i % 11 == 10 else "") for i in range(80))
    rows = [(1, prose(1) + "\n" + menu + "\n" + prose(2)), (2, prose(3) + "\n" + menu), (3, "\u958b\u59cb" + chinese + "\u7d42"),
            (4, "\u53e6" + chinese + "\u4e00\u500b"), (5, prose(4))]
    got = {r.doc_id: r.text for r in S.dedup(frame(spark, rows), lengthen=True).collect()}
    assert got[1] == rows[0][1] and got[3] == rows[2][1] and got[5] == rows[4][1]
    assert not any(f"Dish{i} " in got[2] for i in range(5, 35)) and prose(3) in got[2]
    assert len(got[4]) < 25 and got[4].startswith("\u53e6") and got[4].endswith("\u4e00\u500b") and " " not in got[4]


def brute_lengthened(rows, run=3, min_words=12):
    """(id, text) -> removed sentence numbers: from every sentence the fewest that make ``run`` sentences and
    ``min_words`` words, compared as tuples of words. Ids have one text each."""
    ends, first, places = S._Ends(), {}, []
    for null, i, t in sorted({(i is None, i or 0, t) for i, t in rows if t}):
        flat = [s for line in S.sentences(t, ends) for s in line]
        for at in range(len(flat)):
            to = at + run
            while to < len(flat) and sum(map(len, flat[at:to])) < min_words:
                to += 1
            if to <= len(flat) and sum(map(len, flat[at:to])) >= min_words:
                k = tuple(" ".join(s).lower() for s in flat[at:to])
                first.setdefault(k, (null, i, at))
                places.append((k, (null, i, at), to))
    gone = {}
    for k, (null, i, at), to in places:
        if first[k] != (null, i, at):
            gone.setdefault((null, i), set()).update(range(at, to))
    return [(i, sorted(gone[i is None, i or 0]) if (i is None, i or 0) in gone else None) for i, _ in rows]


@pytest.mark.parametrize("min_words", [12, 20])
def test_lengthened_runs_against_brute_force(spark, min_words):
    """With 20 as the query is registered: short lines, a passage in nearly every document, texts over many partitions, repeated rows, a null id."""
    rng = random.Random(16)
    hot, shared = passage(6000), [passage(6001 + i) for i in range(4)]
    menu = "\n".join(f"Dish{i} {i}" for i in range(30))
    rows = []
    for i in range(120):
        w = prose(2000 + i, 70).split(" ")
        for p in [hot] * (i % 10 > 0) + rng.sample([*shared, menu], i % 3):
            w.insert(rng.randrange(len(w)), p)
        rows.append((i * 37 % 127, " ".join(w)))
    rows += [rows[5], rows[5], (None, rows[9][1]), (500, hot + "\n" + hot), (501, "x. " * 40), (502, ""), (503, None), (504, "A b.")]
    want = order(brute_lengthened(rows, min_words=min_words))
    for parts in (1, 13):
        got = S.dedup(frame(spark, rows).repartition(parts), lengthen=True, min_words=min_words).collect()
        assert order((r.doc_id, sorted(r.removed_sentences) if r.removed_sentences else None) for r in got) == want
    assert sum(g is not None for _, g in want) > 100 and any(g is None for _, g in want)


def test_later_places_of_a_worker():
    import numpy as np
    import pyarrow as pa

    ids, k1 = pa.array([5, None, 3, 3, 5]), np.array([1, 0, 9, 9, 0])
    rank = S._ranks(ids, k1)
    assert rank.tolist() == [2, 3, 0, 0, 1]
    doc, at = np.array([0, 1, 2, 3, 3, 4]), np.array([7, 1, 4, 4, 6, 2])
    h, g = np.array([8, 8, 8, 8, 8, 1]), np.array([0, 0, 0, 0, 0, 0], np.int32)
    assert S._later(h, g, rank[doc], at).tolist() == [True, True, False, False, True, False]
    g[1] = 1
    assert S._later(h, g, rank[doc], at).tolist() == [True, False, False, False, True, False]
    assert S._later(h[:0], g[:0], rank[:0], at[:0]).tolist() == []
    assert S._ranks(pa.array([], pa.int64()), k1[:0]).tolist() == []
