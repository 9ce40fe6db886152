import sqlite3

import duckdb
from pyspark.sql import functions as F

from docs_helper import SF_SMALL
from folio.functions.porter import stem_column, stems
from folio.functions.text import word_tokens
from folio.plans.oracle import stems_sql

PAIRS = {"queries": "queri", "query": "queri", "embeds": "emb", "embed": "emb", "embedding": "embed",
         "naive": "naiv", "running": "run", "transaction": "transact", "etude": "etud",
         "generalizations": "gener", "agreed": "agre", "hopping": "hop", "a": "a", "it": "it",
         "caresses": "caress", "ponies": "poni", "feed": "feed", "plastered": "plaster", "sized": "size", "falling": "fall",
         "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "rational": "ration", "vietnamization": "vietnam",
         "triplicate": "triplic", "electriciti": "electr", "hopefulness": "hope", "adoption": "adopt", "probate": "probat",
         "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "syzygy": "syzygi", "naïveté": "naïveté"}


def test_known_stems(spark):
    df = spark.createDataFrame([(w,) for w in PAIRS], "term string")
    assert {r.term: r.stem for r in df.withColumn("stem", stem_column(F.col("term"))).collect()} == PAIRS
    assert {r.term: r.stem for r in stems(df.union(df)).collect()} == PAIRS


def test_vocabulary_matches_fts5_porter(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    texts = [r.text for r in docs.select("text").collect()]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(doc, tokenize='porter')")
    con.executemany("insert into f(doc) values (?)", [(t,) for t in texts])
    con.execute("create virtual table v using fts5vocab('f', 'row')")
    fts = {r[0] for r in con.execute("select term from v")}
    terms = docs.select(F.explode(word_tokens(F.col("text"))).alias("term"))
    found = stems(terms).collect()
    assert {r.stem for r in found} == fts
    con = duckdb.connect()
    con.execute("create table words(term varchar)")
    words = [*{r.term for r in found}, *PAIRS]
    con.executemany("insert into words values (?)", [(w,) for w in words[:3000] + list(PAIRS)])
    sql = dict(con.execute(f"with {stems_sql('select distinct term from words')} select term, stem from stems").fetchall())
    assert all(sql[w] == s for w, s in PAIRS.items())
    mine = {r.term: r.stem for r in found}
    assert all(mine[w] == s for w, s in sql.items() if w in mine)


def test_words_are_stemmed_where_they_are_cut(spark, tmp_path):
    import random

    from docs_helper import docs_frame
    from folio.functions import porter as P
    from folio.operators import analysis as A
    from folio.operators.cutting import term_places
    from folio.plans import index as IX

    rng, ends = random.Random(2), [s for s, _ in P.STEP2 + P.STEP3] + P.STEP4 + ["s", "sses", "ies", "ss", "ed", "eed", "ing", "y", "e", "ll", ""]
    made = {"".join(rng.choice("aeiouybtslzwxé1") for _ in range(rng.randrange(6))) + rng.choice(ends) + rng.choice(ends) for _ in range(3000)}
    words = sorted({*made, *PAIRS, "x" * 70, "ß" * 33} - {""})
    want = {r.term: r.stem for r in stems(spark.createDataFrame([(w,) for w in words], "term string")).collect()}
    assert dict(zip(words, P.Stemmer(known=100)(words))) == want
    docs = docs_frame(spark, [(i, "p", "function", "Mod.running/1", " ".join(rng.choices(words, k=50)) + " runs run") for i in range(30)])
    key = ["package", "id", "col", "pos", "term"]
    flat = lambda df: sorted(map(str, df.select(*[F.col(c).cast("string").alias(c) for c in key]).collect()))
    IX.build_search_index(docs, str(tmp_path / "index"), stem=True)
    assert flat(IX.read_index(spark, str(tmp_path / "index"))) == flat(A.postings(docs, stem=True))
    cut = term_places(A.with_index_title(docs), "ititle", stem=True)
    assert cut.groupBy("package", "id", "col", "term").count().where("count > 1").isEmpty()
