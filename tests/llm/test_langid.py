import random
from collections import Counter

from folio.llm import langid as I
from llm_helpers import frame


def brute_grams(text):
    t = "".join(c if c.isalpha() else " " for c in text.lower())
    t = " " + " ".join(t.split()) + " "
    if not t.strip():
        return Counter()
    return Counter(c for c in t if c != " ") + Counter(zip(t, t[1:])) + Counter(zip(t, t[1:], t[2:]))


def code(gram):
    n = [0 if c == " " else ord(c) for c in gram]
    if len(n) == 1:
        return n[0]
    if len(n) == 2:
        return (n[0] << 21 | n[1]) + (1 << 61)
    return (n[0] << 42 | n[1] << 21 | n[2]) ^ (1 << 62)


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def brute_rank(counts, most):
    coded = [(-n, signed(code(g))) for g, n in counts.items()]
    return [c for _, c in sorted(coded)[:most]]


def brute_predict(text, known, most):
    own = brute_rank(brute_grams(text or ""), most)
    if not own or not known:
        return "und", 0.0
    far = {}
    for lang in sorted(known):
        place = {g: i for i, g in enumerate(known[lang])}
        far[lang] = sum(abs(place[g] - i) if g in place else most for i, g in enumerate(own))
    best = min(sorted(far), key=lambda k: far[k])
    return best, 1 - far[best] / (most * len(own))


def sample(lang, seed, n=60):
    rng = random.Random(seed)
    parts = {"a": ["the", "ing", "and", "tion"], "b": ["ñas", "que", "ción", "los"], "c": ["жен", "ств", "ого", "при"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n)).capitalize() + "."


def test_against_brute_force(spark):
    rows = [(i, sample("abc"[i % 3], i), "abc"[i % 3]) for i in range(45)] + [(90, "x", None), (91, None, "a"), (92, "", "d")]
    known = I.profiles(frame(spark, rows), most=80)
    want = {}
    for lang in "abc":
        total = sum((brute_grams(t) for _, t, k in rows if k == lang and t), Counter())
        want[lang] = brute_rank(total, 80)
    assert known == want
    tests = [(i, sample("abc"[i % 3], 1000 + i, 12)) for i in range(30)] + [(50, "A the!"), (51, "99 --"), (52, "й"), (53, "\U00020000 and")]
    df = frame(spark, tests)
    got = df.select("doc_id", I.predict(df.text, known, 80).alias("p")).collect()
    for r, (i, t) in zip(sorted(got), tests, strict=True):
        lang, score = brute_predict(t, known, 80)
        assert (r.doc_id, r.p.lang) == (i, lang) and abs(r.p.score - score) < 1e-12 and 0 <= r.p.score <= 1


def test_held_out_accuracy(spark):
    from folio.llm.queries import op5_language

    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = op5_language(spark, d).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 250
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.99


def test_odd_rows(spark, odd, empty):
    df, rows = odd
    known = I.profiles(df)
    assert set(known) == {"en"}
    got = df.select("doc_id", I.predict(df.text, known).alias("p")).collect()
    assert len(got) == len(rows)
    blank = {3, 4, 5}
    assert all((r.p.lang == "und") == (r.doc_id in blank or r.p.score == 0 and r.doc_id is None) for r in got)
    assert I.profiles(empty) == {}
    assert df.select(I.predict(df.text, {}).alias("p")).where("p.lang <> 'und' or p.score <> 0").count() == 0
    assert empty.select(I.predict(empty.text, known).alias("p")).collect() == []
