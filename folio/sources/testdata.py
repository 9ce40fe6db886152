"""Adaptor views from the driver's tables to the documentation data model.

Each adaptor is a pure DataFrame over the given parquet tables, so its work
grows with them. The SQL text next to each adaptor defines the same view for
the DuckDB oracle (``documents``, ``lineitem`` ... are registered there).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.text import WORD_PATTERN
from folio.functions.titles import CODE_TYPES, DOC_TYPES
from folio.session import spread

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- docs

#: Characters of a text in which its first two words are looked for first.
HEAD = 300


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``docs(id, package, ref, type, title, doc)`` from ``documents``; titles are derived from the text."""
    return _docs_plan(spark, sf_dir)


def _docs_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The first two words only, looked for in the head of a text, and in all of it where the head does not have both with their ends:
    # a regular expression decodes all that it is given, however little of it decides.
    other = r"[^\p{L}\p{N}]"
    text, second, both = F.col("_text"), f"{WORD_PATTERN}{other}+({WORD_PATTERN})", f"{WORD_PATTERN}{other}+{WORD_PATTERN}{other}"
    head = F.substring("text", 1, HEAD)
    d = spread(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "text", F.when(head.rlike(both), head).otherwise(F.col("text")).alias("_text"))
    d = d.select(
        "doc_id", "source", "text", F.coalesce(F.regexp_substr(text, F.lit(WORD_PATTERN)), F.lit("x")).alias("_w1"),
        F.when(text.rlike(second), F.regexp_extract(text, second, 1)).otherwise("x").alias("_w2"))
    w1, w2 = F.col("_w1"), F.col("_w2")
    i = F.col("doc_id")
    type_ = F.element_at(F.array(*[F.lit(t) for t in DOC_TYPES]), (i % 12 + 1).cast("int"))
    code = F.when((F.floor(i / 12) % 5) == 0, F.concat_ws("", w1, F.lit(" "), w2, F.lit(" - "), F.col("source"))) \
        .otherwise(F.concat_ws("", w1, F.lit("."), w2, F.lit("/"), (i % 4).cast("string")))
    k = F.floor(i / 12) % 3
    other = F.when(k == 0, F.concat_ws("", w1, F.lit("."), w2)) \
        .when(k == 1, F.concat_ws("", w1, F.lit(" "), w2, F.lit(" - "), F.col("source"))) \
        .otherwise(F.concat_ws("", w1, F.lit(" - "), w2, F.lit(" - "), F.col("source")))
    task = F.when(i % 24 < 12, F.concat_ws("", F.lit("mix "), F.lower(w1), F.lit("."), F.lower(w2))) \
        .otherwise(F.concat_ws("", F.lit("Mix.Tasks."), w1, F.lit("."), w2))
    d = d.withColumn("_type", type_)
    type_ = F.col("_type")
    title = F.when(type_ == "task", task) \
        .when(type_.isin("function", "callback", "macro", "macrocallback", "opaque", "type"), code) \
        .otherwise(other)
    return d.select(
        i.alias("id"),
        F.col("source").alias("package"),
        F.concat_ws("", F.col("source"), F.lit(".html#"), i.cast("string")).alias("ref"),
        type_.alias("type"),
        title.alias("title"),
        F.col("text").alias("doc"),
    )


def _names(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


DOCS_SQL = r"""
docs AS (
  SELECT id, package, ref, type,
    CASE
      WHEN type = 'task' THEN
        CASE WHEN id %% 24 < 12 THEN 'mix ' || lower(w1) || '.' || lower(w2)
             ELSE 'Mix.Tasks.' || w1 || '.' || w2 END
      WHEN type IN (%(code)s) THEN
        CASE WHEN (id // 12) %% 5 = 0 THEN w1 || ' ' || w2 || ' - ' || package
             ELSE w1 || '.' || w2 || '/' || CAST(id %% 4 AS VARCHAR) END
      ELSE
        CASE WHEN (id // 12) %% 3 = 0 THEN w1 || '.' || w2
             WHEN (id // 12) %% 3 = 1 THEN w1 || ' ' || w2 || ' - ' || package
             ELSE w1 || ' - ' || w2 || ' - ' || package END
    END AS title,
    doc
  FROM (
    SELECT doc_id AS id, source AS package, source || '.html#' || CAST(doc_id AS VARCHAR) AS ref,
      ([%(types)s])[doc_id %% 12 + 1] AS type,
      coalesce(regexp_extract_all(text, '[\p{L}\p{N}]+')[1], 'x') AS w1,
      coalesce(regexp_extract_all(text, '[\p{L}\p{N}]+')[2], 'x') AS w2,
      text AS doc
    FROM documents
  ) s
)""" % {"code": _names(CODE_TYPES), "types": _names(DOC_TYPES)}


# ---------------------------------------------------------------- requests

def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``requests(request_id, q, packages)``, one a conversation turn: the first words of its text, marked as
    required, absent, a field or a prefix in turn; some with a quote, a newline or nothing in them."""
    t = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), "conv_id", "turn",
        F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^ \\n\\t]+"), F.lit(0)).alias("w"))
    w = [F.coalesce(F.get("w", i), F.lit("")) for i in range(4)]
    forms = [[w[0], " ", w[1]], ["+", w[0], " ", w[1]], [w[0], " -", w[1], "  ", w[2]], ["+", w[0], " +", w[1], " -", w[2]],
             ["title:", w[0], "* ", w[1]], ["doc:", w[0], " title:doc:", w[1]], ["-", w[0]], [w[0], "\n", w[1], ' say"', w[2]],
             [""], ["* ", w[3], "*x"]]
    q = F.lit(None).cast("string")
    for k, parts in enumerate(forms):
        text = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
        q = F.when(F.col("request_id") % (len(forms) + 1) == k, text).otherwise(q)
    packages = F.when(F.col("request_id") % 7 != 0, F.concat(
        F.lit("src"), (F.col("conv_id") % 20).cast("string"), F.lit(",src"), (F.col("turn") % 20).cast("string")))
    return t.select(F.col("request_id").cast("bigint").alias("request_id"), q.alias("q"), packages.alias("packages"))


REQUEST_LOG_SQL = r"""
turns AS (SELECT conv_id * 1000 + turn AS request_id, conv_id, turn,
                 list_transform(list_resize(regexp_extract_all(coalesce(text, ''), '[^ \n\t]+'), 4), lambda x: coalesce(x, '')) AS w
          FROM conversations),
requests AS (
  SELECT CAST(request_id AS BIGINT) AS request_id,
    CASE request_id % 11 WHEN 0 THEN w[1] || ' ' || w[2] WHEN 1 THEN '+' || w[1] || ' ' || w[2]
      WHEN 2 THEN w[1] || ' -' || w[2] || '  ' || w[3] WHEN 3 THEN '+' || w[1] || ' +' || w[2] || ' -' || w[3]
      WHEN 4 THEN 'title:' || w[1] || '* ' || w[2] WHEN 5 THEN 'doc:' || w[1] || ' title:doc:' || w[2] WHEN 6 THEN '-' || w[1]
      WHEN 7 THEN w[1] || chr(10) || w[2] || ' say"' || w[3] WHEN 8 THEN '' WHEN 9 THEN '* ' || w[4] || '*x' END AS q,
    CASE WHEN request_id % 7 <> 0 THEN 'src' || (conv_id % 20) || ',src' || (turn % 20) END AS packages
  FROM turns)"""


# ---------------------------------------------------------------- packages

def search_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``packages(name, recent_downloads)`` for the documentation corpus."""
    return (table(spark, sf_dir, "documents")
            .groupBy(F.col("source").alias("name"))
            .agg(F.sum("n_chars").cast("bigint").alias("recent_downloads")))


SEARCH_PACKAGES_SQL = """
packages AS (
  SELECT source AS name, CAST(sum(n_chars) AS BIGINT) AS recent_downloads FROM documents GROUP BY source
)"""


def graph_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``packages(name, recent_downloads)`` for the dependency graph (parts)."""
    return (table(spark, sf_dir, "lineitem")
            .groupBy(F.col("l_partkey").cast("string").alias("name"))
            .agg(F.sum("l_quantity").cast("bigint").alias("recent_downloads")))


GRAPH_PACKAGES_SQL = """
gpackages AS (
  SELECT CAST(l_partkey AS VARCHAR) AS name, CAST(sum(l_quantity) AS BIGINT) AS recent_downloads
  FROM lineitem GROUP BY l_partkey
)"""


def package_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``packages_edges(source, target)``: consecutive returned lines of one order."""
    li = (table(spark, sf_dir, "lineitem")
          .where(F.col("l_returnflag") == "R")
          .select("l_orderkey", "l_linenumber", "l_partkey"))
    a, b = li.alias("a"), li.alias("b")
    return (a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey"))
                   & (F.col("b.l_linenumber") == F.col("a.l_linenumber") + 1))
            .where(F.col("a.l_partkey") != F.col("b.l_partkey"))
            .select(F.col("a.l_partkey").cast("string").alias("source"),
                    F.col("b.l_partkey").cast("string").alias("target"))
            .distinct())


EDGES_SQL = """
edges AS (
  SELECT DISTINCT CAST(a.l_partkey AS VARCHAR) AS source, CAST(b.l_partkey AS VARCHAR) AS target
  FROM lineitem a JOIN lineitem b
    ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'R' AND a.l_partkey <> b.l_partkey
)"""


def _name_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(name, parent)`` for each part: its words, its two-word name and that with its type."""
    p = table(spark, sf_dir, "part").select(F.split("p_name", " ").alias("w"), F.lower("p_type").alias("t"))
    full = F.array_join("w", "_")
    return p.select(F.explode(F.array(
        F.struct(full.alias("name"), F.get("w", 0).alias("parent")),
        F.struct(F.concat_ws("_", full, "t").alias("name"), full.alias("parent")),
        F.struct(F.get("w", 0).alias("name"), F.lit(None).cast("string").alias("parent")),
        F.struct(F.get("w", 1).alias("name"), F.lit(None).cast("string").alias("parent")))).alias("n")) \
        .select("n.*").where("name <> ''")


def package_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``packages(name, recent_downloads)`` for name similarity: the words of part names, part names with '_'
    for space, and these with the part's type; downloads = number of part rows."""
    return _name_rows(spark, sf_dir).groupBy("name").agg(F.count(F.lit(1)).alias("recent_downloads"))


NAMES_SQL = """
name_rows AS (
  SELECT replace(p_name, ' ', '_') AS name, split_part(p_name, ' ', 1) AS parent FROM part
  UNION ALL SELECT replace(p_name, ' ', '_') || '_' || lower(p_type), replace(p_name, ' ', '_') FROM part
  UNION ALL SELECT unnest([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)]), NULL FROM part),
npackages AS (SELECT name, count(*) AS recent_downloads FROM name_rows WHERE name <> '' GROUP BY name)"""


def name_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph over these names: a chain below each parent (a word, a two-word name) of the names that start with
    it, in order. Names are near their first word, far from it, or, of a second word, never reached."""
    from pyspark.sql import Window

    n = _name_rows(spark, sf_dir).where("parent is not null").distinct()
    before = F.lag("name").over(Window.partitionBy("parent").orderBy("name"))
    return n.select(F.coalesce(before, "parent").alias("source"), F.col("name").alias("target"))


NAME_EDGES_SQL = """
nedges AS (
  SELECT coalesce(lag(name) OVER (PARTITION BY parent ORDER BY name), parent) AS source, name AS target
  FROM (SELECT DISTINCT name, parent FROM name_rows WHERE parent IS NOT NULL) s)"""


# ---------------------------------------------------------------- vectors

def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, embedding)`` document vectors."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def with_sql(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


# ---------------------------------------------------------------- doc-package graph

def doc_package_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``packages_edges(source, target)`` between documentation packages that hold
    an exact copy of the same text (both directions).

    Copies are first reduced to the distinct package set of each text, so a
    text copied into a third of all rows costs one row per package, and pairs
    are only formed inside each distinct set (bounded by packages squared).
    """
    d = table(spark, sf_dir, "documents").select(F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"), "source")
    sets = (d.groupBy("h", "g").agg(F.array_sort(F.collect_set("source")).alias("pk"))
            .where(F.size("pk") > 1).select("pk").distinct())
    a = sets.select("pk", F.explode("pk").alias("source"))
    return (a.select("source", F.explode("pk").alias("target"))
            .where(F.col("source") != F.col("target")).distinct())


DOC_EDGES_SQL = """
dedges AS (
  SELECT DISTINCT a.source AS source, b.source AS target
  FROM documents a JOIN documents b ON a.text = b.text AND a.source <> b.source
)"""


def doc_package_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``similarly_named(package, package_group)`` for documentation packages:
    the group of a package is its most frequent document language (ties by
    language), standing in for a name group in J8-style joins."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("source").orderBy(F.desc("n"), "lang")
    return (c.withColumn("r", F.row_number().over(w)).where(F.col("r") == 1)
            .select(F.col("source").alias("package"), F.col("lang").alias("package_group")))


DOC_GROUPS_SQL = """
dgroups AS (
  SELECT source AS package, lang AS package_group FROM (
    SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r
    FROM documents GROUP BY source, lang) s
  WHERE r = 1
)"""
