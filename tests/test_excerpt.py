import random
import sqlite3

from pyspark.sql import functions as F

from folio.functions.porter import stem_tokens
from folio.functions.text import word_tokens
from folio.operators.excerpt import excerpts

PHRASES = "id bigint, doc string, phrases array<struct<tokens:array<string>,is_prefix:boolean>>"


def snippets(spark, rows, stem=False):
    """Excerpts of (doc, [(tokens, is_prefix), ...]) rows, in order."""
    df = spark.createDataFrame([(i, d, p) for i, (d, p) in enumerate(rows)], PHRASES).withColumn("package", F.lit("p"))
    tokens = word_tokens(F.col("doc"))
    postings = df.select("package", "id", F.lit(1).alias("col"), F.posexplode(stem_tokens(tokens) if stem else tokens).alias("pos", "term"))
    return [r.excerpt for r in sorted(excerpts(df.select("package", "id", "phrases"), postings, df).select("id", "excerpt").collect())]


def W(a, b):
    return " ".join(f"w{i}" for i in range(a, b))


def test_goldens(spark):
    toks = [f"w{i}" for i in range(60)]
    toks[25], toks[50], toks[55] = "apple", "apple", "pear"
    cases = [
        (W(0, 60) + " apple", [(["apple"], False)], "..." + W(41, 60) + " <em>apple</em>"),
        ("apple " + W(0, 40), [(["apple"], False)], "<em>apple</em> " + W(0, 19) + "..."),
        (" ".join(toks), [(["apple"], False), (["pear"], False)],
         "..." + W(40, 50) + " <em>apple</em> " + W(51, 55) + " <em>pear</em> " + W(56, 60)),
        (W(0, 5) + ". Start of w5 w6 w7 apple " + W(8, 40), [(["apple"], False)],
         "...Start of w5 w6 w7 <em>apple</em> " + W(8, 22) + "..."),
        ("  (lead) " + W(0, 25) + " red apple, " + W(0, 30), [(["red", "apple"], False)],
         "..." + W(16, 25) + " <em>red apple</em>, " + W(0, 9) + "..."),
        (W(0, 30), [], W(0, 20) + "..."), (None, [(["a"], False)], None), ("", [(["a"], False)], ""), (" - ", None, " - "),
        ("a b", None, "a b"), ("cafe\u0301s here", [(["cafes"], False)], "<em>cafe\u0301s</em> here")]
    assert snippets(spark, [c[:2] for c in cases]) == [c[2] for c in cases]
    assert snippets(spark, [("Some Queries ran", [(["queri"], False)])], stem=True) == ["Some <em>Queries</em> ran"]


def test_against_fts5_snippet(spark):
    rng = random.Random(11)
    vocab = ["apple", "pear", "fig", "kiwi", "plum"] + [f"x{i}" for i in range(30)]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(title, doc, tokenize='unicode61')")
    rows, want = [], []
    for _ in range(800):
        doc = "".join(rng.choice(vocab) + rng.choice([" ", " ", ". ", ": ", ", ", "-", "  "])
                      for _ in range(rng.randint(1, 80))).strip()
        q = rng.sample(["apple", "pear", "fig", "kiwi x1", "ap"], rng.randint(1, 3))
        expr = " OR ".join('"ap"*' if s == "ap" else f'"{s}"' for s in q)
        con.execute("delete from t")
        con.execute("insert into t(rowid, title, doc) values (1, 'zz', ?)", (doc,))
        r = con.execute("select snippet(t, 1, '<em>', '</em>', '...', 20) from t where t match ?", (expr,)).fetchall()
        if r:
            rows.append((doc, [(["ap"], True) if s == "ap" else (s.split(), False) for s in q]))
            want.append(r[0][0])
    assert len(rows) > 300
    for got, exp, (doc, q) in zip(snippets(spark, rows), want, rows, strict=True):
        assert got == exp, (q, doc)
