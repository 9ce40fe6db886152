import random
import re

from folio.llm import decontam as D
from llm_helpers import frame, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, span=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), span)
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(item)
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        out.append((doc, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def items_frame(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


def answer(docs, items, **how):
    return order(tuple(r) for r in D.contamination(docs, items, **how).collect())


def case():
    rng = random.Random(4)
    items = [(i, prose(1000 + i, rng.choice([1, 2, 5, 9, 10, 11, 30, 60]))) for i in range(40)]
    items += [(100, None), (101, ""), (None, prose(1003, 30)), (7, items[7][1]), (102, "to " * 30), (103, "a b")]
    rows = []
    for i in range(80):
        w = prose(i, 60).split(" ")
        for _ in range(rng.randrange(4)):  # parts of items, some too short, some side by side
            own = words(rng.choice(items)[1])
            if own:
                a = rng.randrange(len(own))
                at = rng.randrange(len(w))
                w[at:at] = own[a:a + rng.choice([3, 9, 10, 11, 40])]
        rows.append((i, " ".join(w)))
    rows += [(90, "to " * 50), (91, "TO, to. " * 6), (92, items[6][1]), (93, (items[6][1] or "") + " " + (items[5][1] or ""))]
    return rows, items


def test_against_brute_force(spark):
    rows, items = case()
    assert answer(frame(spark, rows), items_frame(spark, items)) == order(brute(rows, items))


def test_blocks_and_other_lengths(spark):
    rows, items = case()
    docs, bench = frame(spark, rows), items_frame(spark, items)
    assert answer(docs, bench, block_words=300) == order(brute(rows, items))
    assert answer(docs, bench, span=6, gram=3) == order(brute(rows, items, 6))


def test_odd_rows(spark, odd, empty):
    df, rows = odd
    pairs = [(r[0], r[1]) for r in rows]
    items = [(1, prose(1)[10:200]), (None, "中文 words"), (3, prose(99, 30_000)[5000:5200])]
    bench = items_frame(spark, items)
    assert answer(df, bench) == order(brute(pairs, items))
    assert answer(df, items_frame(spark, [])) == order(brute(pairs, []))
    assert answer(empty, bench) == []
    kept = D.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    hit = {i for (i, _, n, _) in brute(pairs, items) if n}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        str(r[0]) for r, b in zip(pairs, brute(pairs, items), strict=True) if not b[2])
    assert hit and D.drop_contaminated(empty, bench).count() == 0


def test_no_python_in_the_plan(spark):
    rows, items = case()
    plan = D.contamination(frame(spark, rows), items_frame(spark, items))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan
