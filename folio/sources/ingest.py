"""Ingest of package statistics and documentation JSON (A1-A10, K5).

Readers take either a directory (``spark.read``) or an already loaded JSON
text column, so the same parsing runs on files and on tables. Upserts are a
union plus a window over the key that keeps the newest load; nothing is
collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Standard-library packages added with a fixed download count.
STDLIB_PACKAGES = ["elixir", "eex", "ex_unit", "iex", "logger", "mix"]
STDLIB_DOWNLOADS = 5_000_000

STATS_SCHEMA = T.StructType([T.StructField("downloads", T.StructType([
    T.StructField("recent", T.LongType())]))])
ITEM = T.StructType([T.StructField(n, T.StringType()) for n in ("ref", "title", "type", "doc")])
ITEMS_OBJECT = T.StructType([T.StructField("items", T.ArrayType(ITEM))])
ITEMS_LIST = T.ArrayType(ITEM)
LENIENT = {"allowBackslashEscapingAnyCharacter": "true", "allowUnquotedControlChars": "true"}


def name_from_file(path: Column) -> Column:
    """File name without its trailing '.json' (repeated suffixes removed)."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"(\.json)+$", "")


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """A1 from files: one JSON object per file, package name from the file name."""
    raw = spark.read.text(path, wholetext=True).select(
        F.col("value").alias("json"), name_from_file(F.col("_metadata.file_name")).alias("name"))
    return parse_stats(raw)


def parse_stats(raw: DataFrame) -> DataFrame:
    """A1: ``(name, recent_downloads)`` from ``(name, json)``; missing count -> 0."""
    s = F.from_json(F.col("json"), STATS_SCHEMA)
    return raw.select("name", F.coalesce(s["downloads"]["recent"], F.lit(0)).cast("bigint")
                      .alias("recent_downloads"))


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str], seq: str | None = None) -> DataFrame:
    """Union, and on a key clash the incoming row wins (newest load).

    ``seq``: a column of ``incoming`` that orders its rows; of several with one
    key the last in this order wins. It is not part of the result. One
    aggregate with map-side partial maxima, so a hot key is no hot task.
    """
    names = existing.columns
    order = F.col(seq) if seq else F.lit(0)
    old = existing.select(F.lit(0).alias("_load"), F.lit(None).cast(incoming.select(order).schema[0].dataType).alias("_seq"),
                          *names)
    new = incoming.select(F.lit(1).alias("_load"), order.alias("_seq"), *names)
    rest = [c for c in names if c not in key]
    newest = old.unionByName(new).groupBy(*key).agg(
        F.max(F.struct("_load", "_seq", *rest)).alias("_row"))
    return newest.select(*[F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in names])


def add_stdlib(packages: DataFrame, names: list[str] | None = None,
               downloads: int = STDLIB_DOWNLOADS) -> DataFrame:
    """A3: add the standard-library packages with a fixed download count."""
    spark = packages.sparkSession
    lib = spark.createDataFrame([(n, int(downloads)) for n in (names or STDLIB_PACKAGES)],
                                "name string, recent_downloads bigint")
    return upsert(packages, lib, ["name"])


def repair_json(json: Column) -> Column:
    """A5 text fixes that parser options do not cover: quote a bare ``<<...>>`` doc
    value, delimiters included, and drop the backslash of ``\\#{``."""
    fixed = F.replace(json, F.lit('"doc":<<'), F.lit('"doc":"<<'))
    fixed = F.replace(fixed, F.lit('>>,"'), F.lit('>>","'))
    return F.replace(fixed, F.lit("\\#{"), F.lit("#{"))


def parse_with_repair(raw: DataFrame, schema: T.DataType, json_col: str = "json") -> DataFrame:
    """Strict parse; rows that fail are repaired and parsed leniently.

    Adds ``parsed`` (struct or null) and ``repaired`` (bool). Failure is seen
    through the corrupt-record column, since a strict parse may return a
    struct with null fields rather than null.
    """
    fields = schema.fields if isinstance(schema, T.StructType) else []
    with_corrupt = T.StructType(list(fields) + [T.StructField("_corrupt", T.StringType())])
    strict = F.from_json(F.col(json_col), with_corrupt, {"columnNameOfCorruptRecord": "_corrupt",
                                                         "mode": "PERMISSIVE"})
    df = raw.withColumn("_s", strict)
    failed = F.col("_s").isNull() | F.col("_s._corrupt").isNotNull()
    lenient = F.from_json(repair_json(F.col(json_col)), with_corrupt,
                          {**LENIENT, "columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    df = df.withColumn("repaired", failed).withColumn("_p", F.when(failed, lenient).otherwise(F.col("_s")))
    ok = F.col("_p").isNotNull() & F.col("_p._corrupt").isNull()
    cols = [F.col("_p")[f.name].alias(f.name) for f in fields]
    return df.select(*[c for c in raw.columns], F.when(ok, F.struct(*cols)).alias("parsed"), "repaired")


def error_position(json: Column) -> Column:
    """Where a text that cannot be parsed goes wrong (from 1): its first illegal escape or raw control
    character, else its end (a text cut short)."""
    spots = [F.regexp_instr(json, F.lit(p)) for p in (r'\\[^"\\/bfnrtu]', r"[\x00-\x08\x0b\x0c\x0e-\x1f]")]
    return F.coalesce(F.least(*[F.when(x > 0, x) for x in spots]), F.char_length(json))


def quarantine(parsed: DataFrame, json_col: str = "json", width: int = 20) -> DataFrame:
    """Rows still unparsed after repair, with the text round the error: ``width`` characters
    of the repaired text, half of them before it."""
    fixed = repair_json(F.col(json_col))
    start = F.greatest(error_position(fixed) - width // 2 + 1, F.lit(1))
    return parsed.where(F.col("parsed").isNull()).select(
        *[c for c in parsed.columns if c not in ("parsed", "repaired")],
        F.substr(fixed, start, F.lit(width)).alias("context"))


def items_with_repair(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(package, json, ...)`` rows, one a file -> (items, quarantine).

    Each text is parsed strictly, then repaired and parsed again. ``items`` has
    ``(package, ref, title, type, doc)`` with a null type as ``extras``; what cannot be
    parsed, or holds no list of items, is in ``quarantine`` with all columns of
    ``raw`` and the text round the error. No file is in neither (one with an
    empty list has no items and is no error).
    """
    text = F.trim(F.col("json"))
    wrapped = raw.withColumn("_text", F.when(text.startswith("["), F.concat(F.lit('{"items":'), text, F.lit("}")))
                             .otherwise(F.col("json")))
    parsed = parse_with_repair(wrapped, ITEMS_OBJECT, "_text")
    parsed = parsed.withColumn("parsed", F.when(F.col("parsed.items").isNotNull(), F.col("parsed")))
    bad = quarantine(parsed).drop("_text")
    return _flat_items(parsed.select("package", F.explode("parsed.items").alias("it"))), bad


def read_docs_items(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A4-A6 from a folder of JSON files, package name from the file name: (items, quarantine), the latter
    with the ``file`` it is about."""
    raw = spark.read.text(path, wholetext=True).select(
        name_from_file(F.col("_metadata.file_name")).alias("package"), F.col("_metadata.file_path").alias("file"),
        F.col("value").alias("json"))
    return items_with_repair(raw)


def _flat_items(items: DataFrame) -> DataFrame:
    return items.select("package", F.col("it.ref").alias("ref"), F.col("it.title").alias("title"),
                        F.coalesce(F.col("it.type"), F.lit("extras")).alias("type"), F.col("it.doc").alias("doc"))


def select_packages(packages: DataFrame, min_downloads: float = 500) -> DataFrame:
    """Packages to index, most downloaded first (a distributed range sort;
    no global window, so no single task sees every package)."""
    return packages.where(F.col("recent_downloads") > min_downloads) \
        .orderBy(F.desc("recent_downloads"), "name")


def package_band(packages: DataFrame, low: float = 500, high: float = 2500,
                 exclude_like: str = "sqlite_%") -> DataFrame:
    """A10: low < downloads <= high, name not LIKE ``exclude_like`` ('_' is a wildcard)."""
    return packages.where((F.col("recent_downloads") > low) & (F.col("recent_downloads") <= high)
                          & ~F.col("name").like(exclude_like))


SERVING = ["id", "ref", "type", "title", "doc"]


def serving_docs(docs: DataFrame) -> DataFrame:
    """The serving schema, every column non-null."""
    return docs.select(*SERVING).where(serving_fault().isNull())


def serving_fault() -> Column:
    """The first column of the serving schema that is null; null for a row it takes."""
    return F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"null {c}")) for c in SERVING])


def serving_quarantine(docs: DataFrame) -> DataFrame:
    """The rows that the serving schema rejects, with the ``reason``."""
    return docs.withColumn("reason", serving_fault()).where(F.col("reason").isNotNull())
