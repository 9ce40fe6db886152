"""The registered queries: one per operator family, each with its DuckDB oracle.

``QUERIES[name] = fn(spark, sf_dir) -> DataFrame`` and ``ORACLE[name] = sql``.
Every query reads the driver's tables (through the adaptors) over whole
tables; request batches are literal parameters, like a WHERE literal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import titles as T
from folio.operators import analysis as A
from folio.operators import requests as R
from folio.operators.match import match_documents
from folio.plans import oracle as O
from folio.plans.search import autocomplete, search
from folio.sources import testdata as D
from folio.plans.registry import ORACLE, QUERIES, register  # noqa: F401

with_sql = D.with_sql

# ------------------------------------------------------------------ request sets

P3 = "src0,src1,src2"
SEARCH_REQUESTS = [
    (1, "the", P3), (2, "of and", P3), (3, "the +of", P3), (4, "the -and", P3),
    (5, "+the +of -and", P3), (6, "th*", P3), (7, "title:the", P3), (8, "doc:de", "src3,src4"),
    (9, "the_of", P3), (10, "", "src0"), (11, "-the", "src0"), (12, "+", "src0"),
    (13, "*", "src0"), (14, "title:", "src0"), (15, "the -", "src0"), (16, "title:doc:the", "src0"),
    (17, "the", "src0,src0"), (18, "the", "nope"), (19, "the", None), (20, "! the", "src1"),
    (21, "+! the", "src1"), (22, "the -!", "src1"), (23, 'say"hi the', "src2"), (24, "x:y", "src5"),
    (25, "+the", P3), (26, "en la", "src0,src3,src4"), (27, "und der", "src6,src7"),
    (28, "t*e of", "src8"), (29, "title:mix", "src9,src10"), (30, "tasks", "src11,src12"),
]
MATCH_SETS = {
    "match_term": [(1, "the", P3), (2, "and", "src3"), (3, "de", "src4,src5"), (4, "zzzzzz", P3)],
    "match_phrase": [(1, "of_the", P3), (2, "in_the", "src3,src4"), (3, "de_la", "src0,src5"),
                     (4, "the_the", P3)],
    "match_prefix": [(1, "th*", P3), (2, "an*", "src3"), (3, "of_th*", "src4,src5"),
                     (4, "title:mi*", "src9")],
    "match_field": [(1, "title:the", P3), (2, "doc:the", P3), (3, "title:tasks", "src6"),
                    (4, "doc:and +title:the", "src7,src8")],
    "match_any": [(1, "the of", P3), (2, "and de la", "src3,src4"), (3, "zzz the", "src5")],
    "match_all": [(1, "+the +of", P3), (2, "+and +the +of", "src3,src4"), (3, "+the +zzz", "src5")],
    "match_required_optional": [(1, "the +of", P3), (2, "zzz +the", "src3"), (3, "and of +the +in", "src4")],
    "match_not": [(1, "the -and", P3), (2, "+the -of", "src3"), (3, "the of -and -in", "src4,src5"),
                  (4, "-the", "src6")],
    "match_empty_cases": [(1, "", P3), (2, "-the", P3), (3, "+", P3), (4, "*", P3), (5, "title:", P3),
                          (6, "the -", P3), (7, "title:doc:the", P3), (8, "the", None),
                          (9, "the", "nope"), (10, "!", P3), (11, "+! the", P3), (12, "the -!", P3),
                          (13, "! the", P3), (14, "the", "src0,src0")],
}
AUTOCOMPLETE_REQUESTS = [
    (1, "the", P3), (2, "mix", "src0,src1,src2,src3"), (3, "ent +ion", "src4,src5"),
    (4, "ing -the", "src6"), (5, "qu", P3), (6, "tion", "src7,src7"), (7, "doc:the", P3),
    (8, "title:the", "src8"), (9, "", P3), (10, "eau", None), (11, "EAU", "src0,src4"),
    (12, "ion ent", "src9,nope"), (13, "mix -tasks", "src10"), (14, "+en +er", "src11"),
    (15, "ré", "src0"), (16, "aux*", "src12,src13"),
]


def _docs(spark, sf):
    return D.docs(spark, sf)


_INDEXES: dict[tuple, str] = {}


#: The tables of each of a session's indexes; the others are the search index's.
TABLES = {"titles": "titles", "trigrams": "titles", "tricounts": "titles",
          "atitles": "autocomplete", "atrigrams": "autocomplete", "atricounts": "autocomplete"}


def index_path(spark, sf, stem: bool = False, kind: str = "search") -> str:
    """An index of the documents (``kind``: search, titles or autocomplete), built once a session in the shared folder when a query
    first reads it: what is answered from titles needs no body cut into words."""
    from folio.plans import index as IX
    key = (spark.sparkContext.applicationId, sf.rstrip("/"), stem, kind)
    if key not in _INDEXES:
        path = IX.scratch_path(spark, "stemmed" if stem else kind)
        d = _docs(spark, sf)
        if kind == "titles":
            IX.build_title_index(d, path)
        elif kind == "autocomplete":
            IX.build_autocomplete_index(autocomplete_corpus(d), path)
        else:
            IX.build_search_index(d, path, stem=stem)
        _INDEXES[key] = path
    return _INDEXES[key]


def _index(spark, sf, table, stem=False):
    from folio.plans import index as IX
    return IX.read_index(spark, index_path(spark, sf, stem, TABLES.get(table, "search")), table)


# ------------------------------------------------------------------ B1-B5 titles

@register("title_extract_function", with_sql(D.DOCS_SQL) + """
SELECT id, title, string_split(title, '.')[-1] AS fn FROM docs
WHERE type IN ('function','callback','macro','macrocallback','opaque','type')""")
def q_title_extract_function(spark, sf):
    d = _docs(spark, sf).where(F.col("type").isin(T.CODE_TYPES))
    return d.select("id", "title", T.extract_function(F.col("title")).alias("fn"))


@register("title_extras", with_sql(D.DOCS_SQL) + f"""
SELECT id, title, {O.extras_sql('title')} AS extras FROM docs""")
def q_title_extras(spark, sf):
    return _docs(spark, sf).select("id", "title", T.extras_title(F.col("title")).alias("extras"))


@register("title_index", with_sql(D.DOCS_SQL) + f"""
SELECT id, type, title, {O.index_title_sql()} AS ititle FROM docs""")
def q_title_index(spark, sf):
    d = _docs(spark, sf)
    return d.select("id", "type", "title", T.index_title(F.col("type"), F.col("title")).alias("ititle"))


@register("title_task", with_sql(D.DOCS_SQL) + f"""
SELECT id, title, {O.task_title_sql('title')} AS task FROM docs WHERE type = 'task'""")
def q_title_task(spark, sf):
    d = _docs(spark, sf).where(F.col("type") == "task")
    return d.select("id", "title", T.task_title(F.col("title")).alias("task"))


def autocomplete_corpus(docs: DataFrame) -> DataFrame:
    """Code entries without a space in the title, page entries with B2, tasks with B4."""
    code = docs.where(F.col("type").isin(T.AUTOCOMPLETE_CODE_TYPES) & (F.instr("title", " ") == 0)) \
        .select("id", "package", F.col("title").alias("atitle"))
    pages = docs.where(F.col("type").isin(T.AUTOCOMPLETE_PAGE_TYPES)) \
        .select("id", "package", T.extras_title(F.col("title")).alias("atitle"))
    tasks = docs.where(F.col("type") == "task") \
        .select("id", "package", T.task_title(F.col("title")).alias("atitle"))
    return code.unionByName(pages).unionByName(tasks)


AUTOCOMPLETE_CORPUS_SQL = f"""
acorpus AS (
  SELECT id, package, title AS atitle FROM docs
  WHERE type IN ({O.strings(T.AUTOCOMPLETE_CODE_TYPES)})
    AND instr(title, ' ') = 0
  UNION ALL
  SELECT id, package, {O.extras_sql('title')} AS atitle FROM docs WHERE type IN ({O.strings(T.AUTOCOMPLETE_PAGE_TYPES)})
  UNION ALL
  SELECT id, package, {O.task_title_sql('title')} AS atitle FROM docs WHERE type = 'task'
)"""


@register("autocomplete_corpus", with_sql(D.DOCS_SQL, AUTOCOMPLETE_CORPUS_SQL) + "SELECT * FROM acorpus")
def q_autocomplete_corpus(spark, sf):
    return autocomplete_corpus(_docs(spark, sf))


# ------------------------------------------------------------------ C1, C3, C5, C6, C7

@register("tokens", with_sql(D.DOCS_SQL, O.IDX_SQL, O.POSTINGS_SQL)
          + "SELECT id, pos, term AS token FROM postings WHERE col = 1")
def q_tokens(spark, sf):
    return A.tokens(_docs(spark, sf)).select("id", F.col("pos").cast("bigint").alias("pos"), "token")


@register("postings", with_sql(D.DOCS_SQL, O.IDX_SQL, O.POSTINGS_SQL)
          + "SELECT package, id, col, pos, term FROM postings")
def q_postings(spark, sf):
    p = A.postings(_docs(spark, sf))
    return p.select("package", "id", F.col("col").cast("int").alias("col"),
                    F.col("pos").cast("bigint").alias("pos"), "term")


VOCAB_SQL = """
vocab AS (
  SELECT term, count(*) AS doc FROM (
    SELECT DISTINCT id, term FROM postings
  ) s GROUP BY term HAVING count(*) >= 2
)"""


@register("vocabulary", with_sql(D.DOCS_SQL, O.IDX_SQL, O.POSTINGS_SQL, VOCAB_SQL) + "SELECT * FROM vocab")
def q_vocabulary(spark, sf):
    return A.vocabulary(_docs(spark, sf))


@register("corpus_stats", with_sql(D.DOCS_SQL, O.IDX_SQL, O.POSTINGS_SQL) + """
SELECT count(*) AS n_rows, CAST(sum(len(tt) + len(dt)) AS BIGINT) AS n_tokens,
  round(avg(len(tt) + len(dt)), 6) AS avg_tokens FROM ptok""")
def q_corpus_stats(spark, sf):
    return A.corpus_stats(_docs(spark, sf))


TITLE_VOCAB_SQL = f"""
titles AS (SELECT id, {O.tokens_sql('atitle')} AS toks FROM acorpus WHERE atitle IS NOT NULL),
tvocab AS (SELECT term, count(*) AS doc FROM (SELECT DISTINCT id, unnest(toks) AS term FROM titles) s
           GROUP BY term HAVING count(*) >= 2)"""


def title_vocabulary(spark, sf):
    """C5 over the autocomplete titles."""
    return A.title_vocabulary(autocomplete_corpus(_docs(spark, sf)))


@register("title_vocabulary", with_sql(D.DOCS_SQL, AUTOCOMPLETE_CORPUS_SQL, TITLE_VOCAB_SQL) + "SELECT term, doc FROM tvocab")
def q_title_vocabulary(spark, sf):
    return title_vocabulary(spark, sf)


@register("spell_candidates", with_sql(D.DOCS_SQL, AUTOCOMPLETE_CORPUS_SQL, TITLE_VOCAB_SQL) + """
, words AS (SELECT DISTINCT term AS word FROM (SELECT unnest(toks) AS term FROM titles) s
            WHERE term NOT IN (SELECT term FROM tvocab))
SELECT word, term, doc, distance, rk FROM (
  SELECT word, term, doc, distance,
    CAST(row_number() OVER (PARTITION BY word ORDER BY distance, doc DESC, term) AS BIGINT) AS rk
  FROM (SELECT w.word, v.term, v.doc, CAST(levenshtein(
          translate(w.word, 'ßœæøłđ', 'ABCDEF'), translate(v.term, 'ßœæøłđ', 'ABCDEF')) AS BIGINT) AS distance  -- it counts bytes
        FROM words w JOIN tvocab v ON abs(length(v.term) - length(w.word)) <= 2) s
  WHERE distance <= 2) s2
WHERE rk <= 5""")
def q_spell_candidates(spark, sf):
    """The closest known words to every title word that is not one."""
    corpus, known = autocomplete_corpus(_docs(spark, sf)), title_vocabulary(spark, sf)
    words = A.title_terms(corpus).select(F.col("term").alias("word")).distinct() \
        .join(known.select(F.col("term").alias("word")), "word", "left_anti")
    return A.spell_candidates(words, known)


# ------------------------------------------------------------------ D1-D7

@register("request_clauses", with_sql(D.REQUEST_LOG_SQL, O.clauses_sql()) + """
SELECT request_id, clause_no, kind, field, text, is_prefix, rendered, bad FROM clauses""")
def q_request_clauses(spark, sf):
    return R.clauses(D.request_log(spark, sf))


@register("canonical_query", with_sql(D.REQUEST_LOG_SQL, O.clauses_sql()) + """
, g AS (
  SELECT request_id,
    string_agg(CASE WHEN kind = 'optional' THEN rendered END, ' OR ' ORDER BY clause_no DESC) AS o,
    string_agg(CASE WHEN kind = 'required' THEN rendered END, ' AND ' ORDER BY clause_no DESC) AS r,
    string_agg(CASE WHEN kind = 'absent' THEN rendered END, ' ' ORDER BY clause_no DESC) AS a
  FROM clauses GROUP BY request_id
)
SELECT m.request_id, coalesce(CASE
    WHEN n_required = 0 AND n_absent = 0 AND n_optional > 0 THEN o
    WHEN n_required > 0 AND n_absent = 0 AND n_optional = 0 THEN r
    WHEN n_required > 0 AND n_absent = 0 AND n_optional > 0 THEN '(' || o || ') AND ' || r
    WHEN n_required = 0 AND n_absent > 0 AND n_optional > 0 THEN '(' || o || ')  ' || a
    WHEN n_required > 0 AND n_absent > 0 AND n_optional > 0 THEN '(' || o || ') AND ' || r || ' ' || a
    WHEN n_required > 0 AND n_absent > 0 AND n_optional = 0 THEN r || ' ' || a
    ELSE '' END, '') AS expression
FROM meta m LEFT JOIN g ON m.request_id = g.request_id""")
def q_canonical_query(spark, sf):
    return R.canonical_query(D.request_log(spark, sf))


@register("request_packages", with_sql(D.REQUEST_LOG_SQL, O.clauses_sql()) + """
SELECT r.request_id, r.package_pos, r.package, m.valid, m.n_required, m.n_optional, m.n_absent
FROM rp r JOIN meta m ON r.request_id = m.request_id""")
def q_request_packages(spark, sf):
    reqs = D.request_log(spark, sf)
    return R.request_packages(reqs).join(R.request_meta(reqs), "request_id")


# ------------------------------------------------------------------ E1-E11

def _match_query(name, rows):
    sql = with_sql(D.DOCS_SQL, O.IDX_SQL, O.POSTINGS_SQL, O.requests_sql(rows), O.clauses_sql(),
                   O.MATCH_SQL) + "SELECT request_id, package_pos, package, id, title_hit FROM matched"

    def fn(spark, sf):
        reqs = R.requests_frame(spark, rows)
        c = R.clauses(reqs)
        return match_documents(_index(spark, sf, "postings"), c, R.request_packages(reqs), R.request_meta(reqs, c),
                               terms=_index(spark, sf, "terms"), vocab=_index(spark, sf, "vocab"))

    register(name, sql)(fn)


for _name, _rows in MATCH_SETS.items():
    _match_query(_name, _rows)


# ------------------------------------------------------------------ F1-F3, F12, F13, K9-K11

SEARCH_COLS = ["request_id", "result_pos", "package_pos", "package", "id", "ref", "type", "title",
               "base_rank", "boost", "rank", "pkg_rank"]


def _search_df(spark, sf, rows, k=25, stem=False):
    docs, postings, terms, vocab = (_index(spark, sf, t, stem) for t in ("docs", "postings", "terms", "vocab"))
    return search(R.requests_frame(spark, rows), docs, postings, stem=stem, k=k, terms=terms, vocab=vocab)


@register("search", O.search_sql(SEARCH_REQUESTS) + """
SELECT request_id, result_pos, package_pos, package, id, ref, type, title, base_rank, boost,
  round(rank, 6) AS rank, pkg_rank FROM results""")
def q_search(spark, sf):
    return _search_df(spark, sf, SEARCH_REQUESTS).withColumn("rank", F.round("rank", 6)).select(*SEARCH_COLS)


@register("base_rank", O.search_sql(SEARCH_REQUESTS) + """
SELECT request_id, package_pos, id, base_rank FROM ranked""")
def q_base_rank(spark, sf):
    from folio.plans.search import base_rank
    reqs = R.requests_frame(spark, SEARCH_REQUESTS)
    c = R.clauses(reqs)
    m = match_documents(_index(spark, sf, "postings"), c, R.request_packages(reqs), R.request_meta(reqs, c),
                        terms=_index(spark, sf, "terms"), vocab=_index(spark, sf, "vocab"))
    return base_rank(m).select("request_id", "package_pos", "id", "base_rank")


@register("type_boost", with_sql(D.DOCS_SQL) + """
SELECT id, type, title,
  (CASE WHEN type = 'module' THEN (CASE WHEN contains(title, ' ') THEN 0.1 ELSE 0.2 END)
        WHEN type IN ('function', 'callback', 'macro') THEN (CASE WHEN contains(title, ' ') THEN 0.1 ELSE 0.3 END)
        WHEN type = 'task' THEN 0.1 ELSE 0.0 END)::DOUBLE AS boost FROM docs""")
def q_type_boost(spark, sf):
    d = _docs(spark, sf)
    return d.select("id", "type", "title", T.type_boost(F.col("type"), F.col("title")).alias("boost"))


@register("autocomplete", O.autocomplete_sql(AUTOCOMPLETE_REQUESTS) + "SELECT * FROM results")
def q_autocomplete(spark, sf):
    return autocomplete(R.requests_frame(spark, AUTOCOMPLETE_REQUESTS), _docs(spark, sf),
                        titles=_index(spark, sf, "titles"), tri_index=_index(spark, sf, "trigrams"), tri_counts=_index(spark, sf, "tricounts"))


@register("match_substring", O.autocomplete_sql(AUTOCOMPLETE_REQUESTS) + "SELECT * FROM matched")
def q_match_substring(spark, sf):
    from folio.operators.match import substring_matches
    reqs = R.requests_frame(spark, AUTOCOMPLETE_REQUESTS)
    c = R.clauses(reqs)
    meta = R.request_meta(reqs, c, allowed_fields=("title",))
    return substring_matches(_index(spark, sf, "titles"), c, R.request_packages(reqs), meta,
                             tri_index=_index(spark, sf, "trigrams"), tri_counts=_index(spark, sf, "tricounts")).drop("title_hit")


# Further query families register themselves on import.
from folio.plans import catalog_graph  # noqa: E402,F401
from folio.plans import catalog_more  # noqa: E402,F401


# ------------------------------------------------------------------ C2, B6, B8

def _search_full(spark, sf, rows, stem):
    from folio.plans.search import with_excerpts
    res = _search_df(spark, sf, rows, stem=stem)
    return with_excerpts(res, R.requests_frame(spark, rows), _index(spark, sf, "docs", stem), _index(spark, sf, "postings", stem), stem,
                         vocab=_index(spark, sf, "vocab", stem))


@register("search_stemmed", O.search_sql(SEARCH_REQUESTS, stem=True) + """
SELECT request_id, result_pos, package_pos, package, id, ref, type, title, base_rank, boost,
  round(rank, 6) AS rank, pkg_rank FROM results""")
def q_search_stemmed(spark, sf):
    """The search as it is served: documents and requests stemmed."""
    return _search_df(spark, sf, SEARCH_REQUESTS, stem=True).withColumn("rank", F.round("rank", 6)).select(*SEARCH_COLS)


@register("excerpts", O.excerpts_sql(SEARCH_REQUESTS) + """
SELECT request_id, result_pos, id, excerpt FROM results JOIN excerpted USING (request_id, package, id)""")
def q_excerpts(spark, sf):
    r = _search_full(spark, sf, SEARCH_REQUESTS, False)
    return r.select("request_id", "result_pos", "id", F.col("excerpts")[0].alias("excerpt"))


@register("excerpts_stemmed", O.excerpts_sql(SEARCH_REQUESTS, stem=True) + """
SELECT request_id, result_pos, id, excerpt FROM results JOIN excerpted USING (request_id, package, id)""")
def q_excerpts_stemmed(spark, sf):
    r = _search_full(spark, sf, SEARCH_REQUESTS, True)
    return r.select("request_id", "result_pos", "id", F.col("excerpts")[0].alias("excerpt"))


@register("search_json", O.excerpts_sql(SEARCH_REQUESTS) + """
SELECT request_id, CAST(to_json(struct_pack(results := list(struct_pack(ref := ref, type := type, title := title, excerpts := [excerpt],
  rank := rank, package := package) ORDER BY result_pos))) AS VARCHAR) AS body
FROM results JOIN excerpted USING (request_id, package, id) GROUP BY request_id""")
def q_search_json(spark, sf):
    from folio.plans.search import to_json_response
    r = _search_full(spark, sf, SEARCH_REQUESTS, False)
    return to_json_response(r, ["ref", "type", "title", "excerpts", "rank", "package"])


@register("stemmed_vocabulary", with_sql(D.DOCS_SQL, O.IDX_SQL, O.POSTINGS_SQL, O.stems_sql("SELECT DISTINCT term FROM postings")) + """
SELECT stem AS term, count(*) AS doc FROM (SELECT DISTINCT id, stem FROM postings JOIN stems USING (term)) s
GROUP BY stem HAVING count(*) >= 2""")
def q_stemmed_vocabulary(spark, sf):
    return A.vocabulary(_docs(spark, sf), min_docs=2, stem=True)


WORKLOAD_SQL = with_sql(D.DOCS_SQL, O.IDX_SQL, O.POSTINGS_SQL, VOCAB_SQL, D.SEARCH_PACKAGES_SQL) + """
, words AS (SELECT term AS e FROM vocab ORDER BY doc DESC, term LIMIT 13),
names AS (SELECT name AS e FROM packages ORDER BY recent_downloads DESC, name LIMIT 4),
reqs AS (SELECT unnest(range(500)) AS request_id),
drawn AS (
  SELECT request_id, kind, e, row_number() OVER (PARTITION BY request_id, kind ORDER BY md5('42/' || request_id || '/' || e)) AS r,
    ('0x' || substr(md5('42/' || request_id || '/' || kind || ' count'), 1, 8))::BIGINT
      % (CASE WHEN kind = 'q' THEN 3 ELSE 5 END) + 1 AS n
  FROM reqs, (SELECT 'q' AS kind, e FROM words UNION ALL SELECT 'packages', e FROM names))
SELECT request_id, string_agg(e, ' ' ORDER BY r) FILTER (WHERE kind = 'q') AS q,
  string_agg(e, ',' ORDER BY r) FILTER (WHERE kind = 'packages') AS packages
FROM drawn WHERE r <= n GROUP BY request_id"""


@register("random_requests", WORKLOAD_SQL)
def q_random_requests(spark, sf):
    """the benchmark workload drawn from the data (13 most common terms, 4 largest packages)."""
    terms = A.vocabulary(_docs(spark, sf)).orderBy(F.desc("doc"), "term").limit(13)
    names = D.search_packages(spark, sf).orderBy(F.desc("recent_downloads"), "name").limit(4)
    return R.random_workload(terms, names.select(F.col("name").alias("package")), 500, seed=42)
