import random
import re
from collections import Counter

from folio.llm import quality_rules as Q
from llm_helpers import frame, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WS = " \t\n\x0b\x0c\r"


def base(text):
    t = text or ""
    w = WORD.findall(t)
    n = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    cover = {i + k for i in range(len(w) - 4) if n[tuple(w[i:i + 5])] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover))


def norm(line):
    return re.sub("[0-9]+", "0", "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WS)))


def brute(rows, max_docs=10, max_share=.01, min_left=.5):
    docs = {(h, t) for _, t, h in rows if t is not None}
    per_host = Counter(h for h, _ in docs)
    held = Counter((h, k) for h, t in docs for k in {norm(x) for x in t.split("\n") if WORD.search(x)})
    out = []
    for i, t, h in rows:
        b = base(t)
        over = [x for x in (t or "").split("\n") if WORD.search(x) and held[h, norm(x)] > max(max_docs, max_share * per_host[h])]
        lost = sum(len(WORD.findall(x)) for x in over)
        failed = b[0] < 10 or 100 * b[4] > 20 * b[0]
        clean = None if t is None else "\n".join(x for x in t.split("\n") if x not in over)
        out.append((i, *b, failed, lost, not failed and b[0] - lost >= min_left * b[0], clean))
    return out


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, str(r)))


def test_against_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i in range(150):
        lines = prose(i, rng.choice([5, 40, 90])).split("\n")
        for k in range(4):
            if rng.random() < (.3, .1, .05, .5)[k]:
                lines.insert(rng.randrange(len(lines) + 1), f"  Boilerplate line {rng.randrange(9)} of kind K{'abcd'[k]} here")
        if rng.random() < .2:
            lines += lines[:2]
        if rng.random() < .1:
            lines += ["same words again and again | # " * rng.randrange(1, 9)]
        rows.append((i, "\n".join(lines), rng.choice(["x", "x", "y", None])))
    rows += [(200 + i, rows[3][1], "x") for i in range(30)]  # copies are no boilerplate
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert order(Q.rules(df).collect()) == order(brute(rows))
    assert order(Q.rules(df, max_docs=3, max_share=.2, min_left=.8).collect()) == order(brute(rows, 3, .2, .8))
    assert any(r[7] for r in brute(rows))


def test_odd_rows(spark, odd, empty):
    df, rows = odd
    full = [(r[0], r[1], r[3] if len(r) > 3 else "s") for r in rows]
    assert order(Q.rules(df).collect()) == order(brute(full))
    assert order(Q.rules(df, max_docs=0, max_share=0).collect()) == order(brute(full, 0, 0))
    assert Q.rules(empty).collect() == []


def test_no_python_in_the_plan(spark):
    df = frame(spark, [(1, prose(1))])
    plan = Q.rules(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan


def test_documents_are_counted_not_texts(spark):
    """A line of many copies of one text goes with ``copies``, repeated rows are one document, null is an id."""
    text = prose(1, 12) + "\nAll rights reserved by host 7"
    own = [(100 + i, prose(100 + i, 30), "x") for i in range(2000)]
    def lost(rows, **kw):
        df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
        return {r.doc_id: r.n_line_words for r in Q.rules(df, copies=True, **kw).collect()}
    twelve = [(i, text, "x") for i in range(11)] + [(None, text, "x"), (50, "Other.\nALL rights reserved by host 12", "x")]
    assert lost(twelve)[0] == 12 + 6 and lost(twelve)[None] == 18 and lost(twelve)[50] == 6
    assert lost([(i % 9, text, "x") for i in range(30)])[0] == 0
    assert lost(twelve + own)[50] == 0 and lost(twelve + own, max_share=0)[50] == 6
    assert lost([(i, text, "xy"[i % 2]) for i in range(20)])[0] == 0
