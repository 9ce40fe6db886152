"""Driver queries for vectors, ingest and index build/read."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.operators import vectors as V
from folio.plans import index as IX
from folio.plans.registry import register
from folio.sources import ingest as I
from folio.sources import testdata as D

with_sql = D.with_sql


def _index_ctes() -> tuple[str, str]:
    from folio.plans import oracle as O
    return O.IDX_SQL, O.POSTINGS_SQL


VEC_MIN, VEC_ALWAYS = 125_000, ["src1", "src2"]
STATS_MIN = 110_000
SELECT_MIN = 110_000
BAND = (100_000, 140_000, "src1_")


def _attached(spark, sf):
    return V.attach(D.docs(spark, sf), D.vectors(spark, sf))


ATTACH_SQL = """
att AS (SELECT d.*, e.embedding FROM docs d LEFT JOIN embeddings e ON e.vec_id = d.id)"""


# ------------------------------------------------------------------ V1-V5

@register("embedding_attach", with_sql(D.DOCS_SQL, ATTACH_SQL) + """
SELECT id, package, embedding IS NOT NULL AS has_embedding, CAST(len(embedding) AS BIGINT) AS dims FROM att""")
def q_embedding_attach(spark, sf):
    a = _attached(spark, sf)
    return a.select("id", "package", F.col("embedding").isNotNull().alias("has_embedding"),
                    F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("bigint").alias("dims"))


@register("embedding_count", with_sql(D.DOCS_SQL, ATTACH_SQL) + "SELECT count(embedding) AS n_embeddings FROM att")
def q_embedding_count(spark, sf):
    return V.embedding_count(_attached(spark, sf))


@register("embedding_scan", with_sql(D.DOCS_SQL, ATTACH_SQL) + """
SELECT id, CAST(len(embedding) AS BIGINT) AS dims,
  round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS l2
FROM att WHERE embedding IS NOT NULL""")
def q_embedding_scan(spark, sf):
    s = V.embedding_scan(_attached(spark, sf))
    return s.select("id", F.size("embedding").cast("bigint").alias("dims"),
                    F.round(V.norm(F.col("embedding")), 6).alias("l2"))


@register("embedding_backlog", with_sql(D.DOCS_SQL, D.SEARCH_PACKAGES_SQL, ATTACH_SQL) + f"""
SELECT id, doc FROM att
WHERE embedding IS NULL AND doc <> '##'
  AND package IN (SELECT name FROM packages WHERE recent_downloads > {VEC_MIN}
                  OR name IN ({', '.join(repr(x) for x in VEC_ALWAYS)}))
ORDER BY id LIMIT 100""")
def q_embedding_backlog(spark, sf):
    return V.backlog(_attached(spark, sf), D.search_packages(spark, sf), VEC_MIN, VEC_ALWAYS, 100)


KNN_SQL = """
ex AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings),
cen AS (
  SELECT label AS query_id, list(x ORDER BY i) AS q FROM (
    SELECT label, i, avg(x::DOUBLE) AS x FROM ex GROUP BY label, i) s
  GROUP BY label
),
sc AS (
  SELECT c.query_id, e.vec_id AS id,
    list_sum(list_transform(range(1, len(e.embedding) + 1), lambda j: e.embedding[j]::DOUBLE * c.q[j]))
    / (sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE)))
       * sqrt(list_sum(list_transform(c.q, lambda x: x * x)))) AS similarity
  FROM embeddings e, cen c WHERE e.embedding IS NOT NULL
),
knn AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS BIGINT)
    AS rk FROM sc) s WHERE rk <= 10
)"""


def _knn(spark, sf):
    vec = D.table(spark, sf, "embeddings")
    q = V.centroids(vec, "label")
    return q, V.knn_exact(q, D.vectors(spark, sf), 10)


@register("knn_exact", with_sql(D.DOCS_SQL, KNN_SQL) + """
SELECT k.query_id, k.rk, k.id, d.title, d.ref, d.package, d.doc, round(k.similarity, 6) AS similarity
FROM knn k JOIN docs d ON d.id = k.id""")
def q_knn_exact(spark, sf):
    _, knn = _knn(spark, sf)
    d = D.docs(spark, sf).select("id", "title", "ref", "package", "doc")
    # query_id is the label of the centroid; keep the label's own type.
    return knn.join(d, "id").select(F.col("query_id").cast("int").alias("query_id"), "rk", "id", "title", "ref",
                                    "package", "doc", F.round("similarity", 6).alias("similarity"))


#: The query set: every row whose id is divisible by this.
QUERY_STEP = 100


def _query_rows(vec):
    return vec.where((F.col("id") % QUERY_STEP == 0) & F.col("embedding").isNotNull()) \
        .select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))


KNN_ROWS_SQL = """
u AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL),
sc AS (
  SELECT q.id AS query_id, u.id, list_dot_product(u.v, q.v)
    / (sqrt(list_dot_product(u.v, u.v)) * sqrt(list_dot_product(q.v, q.v))) AS similarity
  FROM u, u q WHERE q.id % 100 = 0
)"""


@register("knn_exact_rows", with_sql(KNN_ROWS_SQL) + """
SELECT query_id, rk, id, round(similarity, 6) AS similarity FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS BIGINT) AS rk FROM sc) s
WHERE rk <= 10""")
def q_knn_exact_rows(spark, sf):
    """The whole query set, rows of the table, against all rows."""
    vec = D.vectors(spark, sf)
    return V.knn_exact(_query_rows(vec), vec, 10).select("query_id", "rk", "id", F.round("similarity", 6).alias("similarity"))


@register("knn_lsh")
def q_knn_lsh(spark, sf):
    """The whole query set, rows of the table, against all rows, with the share of rows ranked and the recall."""
    vec = D.vectors(spark, sf)
    q = _query_rows(vec)
    exact = V.knn_exact(q, vec, 10)
    approx = V.knn_lsh(q, vec, 10)
    total = vec.agg(F.count("embedding").alias("total"))
    return approx.join(V.recall(approx, exact), "query_id").join(total).select(
        "query_id", "rk", "id", F.round("similarity", 6).alias("similarity"), "recall",
        (F.col("candidates") / F.col("total")).alias("candidate_share"))


@register("knn_ivf")
def q_knn_ivf(spark, sf):
    """The whole query set through the inverted file, with its recall, the share of rows ranked exactly and of codes looked up."""
    from folio.operators import ivf
    vec = D.vectors(spark, sf)
    q = _query_rows(vec)
    found = ivf.search(ivf.build(vec, 10), q, vec, 10)
    total = vec.agg(F.count("embedding").alias("total"))
    return found.join(V.recall(found, V.knn_exact(q, vec, 10)), "query_id").join(total).select(
        "query_id", "rk", "id", F.round("similarity", 6).alias("similarity"), "recall",
        (F.col("candidates") / F.col("total")).alias("candidate_share"), (F.col("scanned") / F.col("total")).alias("scanned_share"))


# ------------------------------------------------------------------ A1-A10, K5

def _stats_json(spark, sf):
    s = D.search_packages(spark, sf)
    down = F.when(F.col("recent_downloads") > STATS_MIN,
                  F.struct(F.col("recent_downloads").alias("recent")))
    return s.select("name", F.to_json(F.struct(down.alias("downloads"))).alias("json"))


@register("ingest_stats", with_sql(D.SEARCH_PACKAGES_SQL) + f"""
SELECT name, CAST(CASE WHEN recent_downloads > {STATS_MIN} THEN recent_downloads ELSE 0 END AS BIGINT)
  AS recent_downloads FROM packages""")
def q_ingest_stats(spark, sf):
    return I.parse_stats(_stats_json(spark, sf))


DE_SQL = """
incoming AS (SELECT source AS name, CAST(sum(n_chars) AS BIGINT) AS recent_downloads FROM documents
             WHERE lang = 'de' GROUP BY source)"""


@register("ingest_upsert", with_sql(D.SEARCH_PACKAGES_SQL, DE_SQL) + """
SELECT coalesce(i.name, p.name) AS name, coalesce(i.recent_downloads, p.recent_downloads) AS recent_downloads
FROM packages p FULL OUTER JOIN incoming i ON p.name = i.name""")
def q_ingest_upsert(spark, sf):
    inc = (D.table(spark, sf, "documents").where(F.col("lang") == "de")
           .groupBy(F.col("source").alias("name")).agg(F.sum("n_chars").cast("bigint").alias("recent_downloads")))
    return I.upsert(D.search_packages(spark, sf), inc, ["name"])


@register("ingest_stdlib", with_sql(D.SEARCH_PACKAGES_SQL) + f"""
SELECT name, recent_downloads FROM packages
UNION ALL
SELECT unnest([{', '.join(repr(n) for n in I.STDLIB_PACKAGES)}]) AS name,
  CAST({I.STDLIB_DOWNLOADS} AS BIGINT) AS recent_downloads""")
def q_ingest_stdlib(spark, sf):
    return I.add_stdlib(D.search_packages(spark, sf))


@register("max_downloads", with_sql(D.SEARCH_PACKAGES_SQL) + "SELECT max(recent_downloads) AS max_downloads FROM packages")
def q_max_downloads(spark, sf):
    return D.search_packages(spark, sf).agg(F.max("recent_downloads").alias("max_downloads"))


def _items_json(spark, sf):
    d = D.docs(spark, sf)
    item = F.struct("ref", "title", F.when(F.col("type") != "extras", F.col("type")).alias("type"), "doc")
    js = F.when(F.col("type") == "extras", F.to_json(F.array(item))) \
        .otherwise(F.to_json(F.struct(F.array(item).alias("items"))))
    return d.select("package", js.alias("json"))


@register("ingest_items", with_sql(D.DOCS_SQL) + "SELECT package, ref, title, type, doc FROM docs")
def q_ingest_items(spark, sf):
    return I.items_with_repair(_items_json(spark, sf))[0]


def _doc_files(spark, sf):
    """A JSON file a document, of five kinds: a list of items, one with a bare ``<<...>>`` body, one with an illegal
    escape, one cut short and one without items."""
    d = D.docs(spark, sf)
    items = F.to_json(F.struct(F.array(F.struct("doc", "ref", "title", "type")).alias("items")))
    bare = F.concat(F.lit('{"items":[{"doc":<<65, '), F.col("id").cast("string"), F.lit('>>,"ref":"'), "ref",
                    F.lit('","title":"t","type":"task"}]}'))
    escape = F.replace(items, F.lit('"ref":"'), F.lit('"ref":"\\a'))
    kind = F.col("id") % 5
    text = F.when(kind == 0, items).when(kind == 1, bare).when(kind == 2, escape) \
        .when(kind == 3, F.expr("substring(whole, 1, length(whole) - 5)")).otherwise('{"other":1}')
    return d.withColumn("whole", items).select("package", F.concat("ref", F.lit(".json")).alias("file"), text.alias("json"))


@register("ingest_docs_repair", with_sql(D.DOCS_SQL) + """
SELECT package, CASE id % 5 WHEN 2 THEN 'a' || ref ELSE ref END AS ref, CASE id % 5 WHEN 1 THEN 't' ELSE title END AS title,
  CASE id % 5 WHEN 1 THEN 'task' ELSE type END AS type, CASE id % 5 WHEN 1 THEN '<<65, ' || id || '>>' ELSE doc END AS doc,
  NULL AS context
FROM docs WHERE id % 5 < 3
UNION ALL
SELECT package, ref || '.json', NULL, NULL, NULL,
  CASE id % 5 WHEN 3 THEN right(left('"type":"' || type || '"}]}', -5), 10) ELSE right('{"other":1}', 10) END
FROM docs WHERE id % 5 >= 3""")
def q_ingest_docs_repair(spark, sf):
    """Items of the files that can be read or repaired, and the files that cannot, with the text round the error."""
    items, bad = I.items_with_repair(_doc_files(spark, sf))
    none = F.lit(None).cast("string")
    return items.select("package", "ref", "title", "type", "doc", none.alias("context")).unionByName(bad.select(
        "package", F.col("file").alias("ref"), none.alias("title"), none.alias("type"), none.alias("doc"), "context"))


def _broken_events(spark, sf):
    e = D.table(spark, sf, "events").select("event_id", "event_type", "props")
    body = F.expr("substring(props, 1, length(props) - 1)")
    js = (F.when(F.col("event_type") == "error", F.concat(body, F.lit(', "note": "x\\d"}')))
          .when(F.col("event_type") == "click", F.concat(body, F.lit(', "note": "a\tb"}')))
          .when(F.col("event_type") == "view", F.concat(body, F.lit(', "note": "open')))
          .otherwise(F.col("props")))
    return e.select("event_id", js.alias("json"))


EVENT_SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("note", T.StringType())])

BROKEN_SQL = r"""
broken AS (
  SELECT event_id, event_type,
    CASE WHEN event_type = 'error' THEN substr(props, 1, length(props) - 1) || ', "note": "x\d"}'
         WHEN event_type = 'click' THEN substr(props, 1, length(props) - 1) || ', "note": "a' || chr(9) || 'b"}'
         WHEN event_type = 'view' THEN substr(props, 1, length(props) - 1) || ', "note": "open'
         ELSE props END AS json
  FROM events
),
fixed AS (
  SELECT event_id, event_type, json,
    replace(regexp_replace(json, '\\([^"\\/bfnrtu])', '\1', 'g'), chr(9), '\t') AS fj
  FROM broken
)"""


@register("ingest_repair", with_sql(BROKEN_SQL) + """
SELECT event_id, json, CAST(json_extract(fj, '$.k') AS BIGINT) AS k, json_extract_string(fj, '$.note') AS note,
  event_type IN ('error', 'click', 'view') AS repaired
FROM fixed WHERE json_valid(fj)""")
def q_ingest_repair(spark, sf):
    p = I.parse_with_repair(_broken_events(spark, sf), EVENT_SCHEMA)
    return p.where(F.col("parsed").isNotNull()).select("event_id", "json", F.col("parsed.k").alias("k"),
                                                         F.col("parsed.note").alias("note"), "repaired")


@register("ingest_quarantine", with_sql(BROKEN_SQL) + """
SELECT event_id, json, right(json, 10) AS context FROM fixed WHERE NOT json_valid(fj)""")
def q_ingest_quarantine(spark, sf):
    return I.quarantine(I.parse_with_repair(_broken_events(spark, sf), EVENT_SCHEMA))


@register("docs_upsert", with_sql(D.DOCS_SQL) + """
SELECT d.package, d.ref, CASE WHEN x.lang = 'de' THEN d.title || ' (updated)' ELSE d.title END AS title,
  d.type, d.doc
FROM docs d JOIN documents x ON x.doc_id = d.id""")
def q_docs_upsert(spark, sf):
    d = D.docs(spark, sf).select("package", "ref", "title", "type", "doc")
    de = D.table(spark, sf, "documents").where(F.col("lang") == "de").select(F.col("doc_id").alias("id"))
    inc = (D.docs(spark, sf).join(de, "id", "left_semi")
           .select("package", "ref", F.concat("title", F.lit(" (updated)")).alias("title"), "type", "doc"))
    return I.upsert(d, inc, ["package", "ref"])


@register("docs_serving", with_sql(D.DOCS_SQL) + """
SELECT id, ref, type, title, doc FROM docs
WHERE id IS NOT NULL AND ref IS NOT NULL AND type IS NOT NULL AND title IS NOT NULL AND doc IS NOT NULL""")
def q_docs_serving(spark, sf):
    return I.serving_docs(D.docs(spark, sf))


@register("package_select", with_sql(D.SEARCH_PACKAGES_SQL) + f"""
SELECT name, recent_downloads FROM packages WHERE recent_downloads > {SELECT_MIN}""")
def q_package_select(spark, sf):
    return I.select_packages(D.search_packages(spark, sf), SELECT_MIN)


@register("package_band", with_sql(D.SEARCH_PACKAGES_SQL) + f"""
SELECT name, recent_downloads FROM packages
WHERE recent_downloads > {BAND[0]} AND recent_downloads <= {BAND[1]} AND name NOT LIKE '{BAND[2]}'""")
def q_package_band(spark, sf):
    return I.package_band(D.search_packages(spark, sf), *BAND)


# ------------------------------------------------------------------ A11-A15

def _selected(spark, sf):
    return I.select_packages(D.search_packages(spark, sf), SELECT_MIN)


POSTING = ["package", "id", "col", "pos", "term"]


def _postings_out(df):
    return df.select("package", "id", F.col("col").cast("int").alias("col"), F.col("pos").cast("bigint").alias("pos"), "term")


def _postings_sql(where: str) -> str:
    from folio.plans import oracle as O
    return with_sql(D.DOCS_SQL, D.SEARCH_PACKAGES_SQL, O.IDX_SQL, O.POSTINGS_SQL) + f"""
SELECT package, id, col, pos, term FROM postings WHERE {where}"""


IN_SELECTED = f"package IN (SELECT name FROM packages WHERE recent_downloads > {SELECT_MIN})"


@register("index_roundtrip", _postings_sql(IN_SELECTED))
def q_index_roundtrip(spark, sf):
    path = IX.scratch_path(spark, "index")
    IX.build_search_index(D.docs(spark, sf), path, _selected(spark, sf))
    return _postings_out(IX.read_index(spark, path))


@register("index_rebuild", _postings_sql(IN_SELECTED))
def q_index_rebuild(spark, sf):
    """A second build with fewer packages leaves none of the first one's."""
    path = IX.scratch_path(spark, "rebuild")
    IX.build_search_index(D.docs(spark, sf), path)
    IX.build_search_index(D.docs(spark, sf), path, _selected(spark, sf))
    return _postings_out(IX.read_index(spark, path))


def _older(d):
    """An earlier state of the documents: some with another body, some missing, and some that are no more."""
    step = F.col("id") % 100
    gone = d.where(step == 9).withColumn("id", F.col("id") + 1_000_000_000)
    return d.where(step != 8).withColumn("doc", F.when(step == 7, F.concat(F.lit("older "), "doc")).otherwise(F.col("doc"))).unionByName(gone)


@register("index_upsert", _postings_sql("true"))
def q_index_upsert(spark, sf):
    """An index of an earlier state, brought up to date by a delta build and then compacted, has the postings of a full build."""
    path, d = IX.scratch_path(spark, "upsert"), D.docs(spark, sf)
    IX.build_search_index(_older(d), path)
    IX.update_index(d, path)
    IX.compact_index(spark, path)
    return _postings_out(IX.read_index(spark, path))


@register("index_delta_terms", with_sql(D.DOCS_SQL, *_index_ctes()) + """
SELECT package, term, count(*) AS docs FROM (SELECT DISTINCT package, id, col, term FROM postings) s GROUP BY package, term""")
def q_index_delta_terms(spark, sf):
    """The vocabulary of an updated index, from the counts of the first build and the signed counts of the delta."""
    path, d = IX.scratch_path(spark, "delta"), D.docs(spark, sf)
    IX.build_search_index(_older(d), path)
    IX.update_index(d, path)
    return IX.read_index(spark, path, "vocab").select("package", "term", "docs")


@register("index_all_packages", _postings_sql("true"))
def q_index_all_packages(spark, sf):
    path = IX.scratch_path(spark, "index-all")
    IX.build_search_index(D.docs(spark, sf), path, partitioned=False)
    return _postings_out(IX.read_index(spark, path))


@register("index_terms", with_sql(D.DOCS_SQL, *_index_ctes()) + """
SELECT 'term' AS part, package, id, col, term, count(*) AS n FROM postings GROUP BY ALL
UNION ALL SELECT 'vocab', package, NULL, NULL, term, count(*) FROM (SELECT DISTINCT package, id, col, term FROM postings) s
GROUP BY package, term
UNION ALL SELECT 'length', package, id, NULL, NULL, len(tt) + len(dt) FROM ptok""")
def q_index_terms(spark, sf):
    """The tables derived from the postings: terms with their counts, the vocabulary, row lengths."""
    path = IX.scratch_path(spark, "terms")
    IX.build_search_index(D.docs(spark, sf), path)
    null = lambda t: F.lit(None).cast(t)
    rows = lambda part, table, *cols: IX.read_index(spark, path, table).select(F.lit(part).alias("part"), "package", *cols)
    return rows("term", "terms", "id", F.col("col").cast("int").alias("col"), "term", F.col("tf").alias("n")).union(
        rows("vocab", "vocab", null("bigint"), null("int"), "term", "docs")).union(
        rows("length", "lengths", "id", null("int"), null("string"), "dl"))


@register("index_raw_titles", with_sql(D.DOCS_SQL, D.SEARCH_PACKAGES_SQL) + f"""
SELECT package, id, col, CAST(generate_subscripts(toks, 1) - 1 AS BIGINT) AS pos, unnest(toks) AS term FROM (
  SELECT package, id, 0 AS col, regexp_extract_all(strip_accents(lower(title)), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+') AS toks FROM docs
  UNION ALL
  SELECT package, id, 1, regexp_extract_all(strip_accents(lower(doc)), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+') FROM docs) s
WHERE {IN_SELECTED}""")
def q_index_raw_titles(spark, sf):
    path = IX.scratch_path(spark, "index-raw")
    IX.build_search_index(D.docs(spark, sf), path, _selected(spark, sf), raw_titles=True)
    return _postings_out(IX.read_index(spark, path))


@register("index_titles_roundtrip", with_sql(D.DOCS_SQL, D.SEARCH_PACKAGES_SQL, *_index_ctes()[:1]) + f"""
SELECT package, id, ititle, ref, type FROM idx WHERE {IN_SELECTED}""")
def q_index_titles_roundtrip(spark, sf):
    path = IX.scratch_path(spark, "titles")
    IX.build_title_index(D.docs(spark, sf), path, _selected(spark, sf))
    return IX.read_index(spark, path, "titles").select("package", "id", "ititle", "ref", "type")


@register("index_titles_only", with_sql(D.DOCS_SQL, *_index_ctes()[:1]) + """
SELECT package, id, ititle, tri FROM (SELECT package, id, ititle, lower(ititle) AS lt,
  unnest(list_distinct(list_transform(range(1, length(lower(ititle)) - 1), lambda i: substr(lower(ititle), i, 3)))) AS tri
  FROM idx) s""")
def q_index_titles_only(spark, sf):
    """The normalised titles without ref and type, joined to their trigrams."""
    path = IX.scratch_path(spark, "titles-only")
    IX.build_title_index(D.docs(spark, sf), path, with_ref=False)
    titles = IX.read_index(spark, path, "titles")
    assert "ref" not in titles.columns and "type" not in titles.columns
    return titles.join(IX.read_index(spark, path, "trigrams"), ["package", "id"]).select("package", "id", "ititle", "tri")


DAMAGED_SQL = """
damaged AS (SELECT id, package, ref, CASE id % 7 WHEN 0 THEN 'widget' WHEN 1 THEN NULL ELSE type END AS type,
  CASE WHEN id % 11 <> 0 THEN title END AS title, doc FROM docs)"""


@register("docs_quarantine", with_sql(D.DOCS_SQL, DAMAGED_SQL) + """
SELECT id, CASE WHEN type IS NULL THEN 'null type' WHEN type = 'widget' THEN 'unknown type'
  WHEN title IS NULL THEN 'null title' ELSE 'indexed' END AS state FROM damaged""")
def q_docs_quarantine(spark, sf):
    """Every row of a damaged table is in the index or, with the reason, in its quarantine."""
    kind = F.col("id") % 7
    d = D.docs(spark, sf).withColumn("type", F.when(kind == 0, "widget").when(kind != 1, F.col("type"))) \
        .withColumn("title", F.when(F.col("id") % 11 != 0, F.col("title")))
    path = IX.scratch_path(spark, "damaged")
    IX.build_search_index(d, path)
    return IX.read_index(spark, path, "docs").select("id", F.lit("indexed").alias("state")).union(
        IX.read_index(spark, path, "quarantine").select("id", F.col("reason").alias("state")))


@register("serving_quarantine", with_sql(D.DOCS_SQL, DAMAGED_SQL) + """
SELECT id, CASE WHEN type IS NULL THEN 'null type' WHEN title IS NULL THEN 'null title' ELSE 'served' END AS state FROM damaged""")
def q_serving_quarantine(spark, sf):
    """Every row is served or rejected with the first column that is null."""
    kind = F.col("id") % 7
    d = D.docs(spark, sf).withColumn("type", F.when(kind == 0, "widget").when(kind != 1, F.col("type"))) \
        .withColumn("title", F.when(F.col("id") % 11 != 0, F.col("title")))
    return I.serving_docs(d).select("id", F.lit("served").alias("state")).union(
        I.serving_quarantine(d).select("id", F.col("reason").alias("state")))
