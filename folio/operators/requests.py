"""Search requests as tables.

A request ``(request_id, q, packages)`` becomes:

* ``request_packages``: ``(request_id, package_pos, package)``; duplicates kept,
  position is the order of results across packages;
* ``clauses``: one row per query segment with its kind (required / optional /
  absent), column filter, prefix flag, the text to tokenise, and whether the
  match expression would be rejected;
* ``request_meta``: per request counts and validity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Leading markers of a column filter in a query segment.
FIELD_PREFIX = r"(?s)^((?:title:|doc:)*)(.*)$"

REQUEST_SCHEMA = T.StructType([
    T.StructField("request_id", T.LongType(), False),
    T.StructField("q", T.StringType(), True),
    T.StructField("packages", T.StringType(), True),
])


def requests_frame(spark: SparkSession, rows: list[tuple[int, str | None, str | None]]) -> DataFrame:
    """A requests table from literal ``(request_id, q, packages)`` rows;
    ``packages`` is the comma-separated form (null = none)."""
    return spark.createDataFrame(rows, REQUEST_SCHEMA)


def request_packages(requests: DataFrame) -> DataFrame:
    """List as is, string split on ',', null -> no packages."""
    dtype = requests.schema["packages"].dataType
    arr = F.col("packages") if isinstance(dtype, T.ArrayType) else F.split(F.col("packages"), ",", -1)
    return requests.select("request_id", F.posexplode(arr).alias("package_pos", "package")) \
        .withColumn("package_pos", F.col("package_pos").cast("bigint"))


def clauses(requests: DataFrame) -> DataFrame:
    """One row per segment of ``q``.

    Columns: request_id, clause_no, kind, field (title/doc/null), text (what is
    tokenised), is_prefix, rendered (the canonical operand), bad (the operand
    would make the match expression invalid), nested_field.
    """
    segs = F.filter(F.split(F.coalesce(F.col("q"), F.lit("")), " ", -1), lambda x: x != "")
    base = requests.select("request_id", F.posexplode(segs).alias("clause_no", "seg"))
    seg = F.col("seg")
    kind = (F.when(seg.startswith("-"), F.lit("absent"))
            .when(seg.startswith("+"), F.lit("required"))
            .otherwise(F.lit("optional")))
    body = F.when(kind == "optional", seg).otherwise(F.substring(seg, 2, 1 << 30))
    c = base.select(
        "request_id", F.col("clause_no").cast("bigint").alias("clause_no"), "seg",
        kind.alias("kind"), body.endswith("*").alias("is_prefix"),
        F.replace(body, F.lit("*"), F.lit("")).alias("stripped"))
    prefixes = F.regexp_extract("stripped", FIELD_PREFIX, 1)
    rest = F.regexp_extract("stripped", FIELD_PREFIX, 2)
    first_field = F.regexp_extract("stripped", r"^(title|doc):", 1)
    quoted = F.when(rest == "", F.lit("")).otherwise(
        F.concat(F.lit('"'), F.replace(rest, F.lit('"'), F.lit('""')), F.lit('"')))
    operand = F.concat(prefixes, quoted, F.when(F.col("is_prefix"), F.lit("*")).otherwise(F.lit("")))
    rendered = F.when(F.col("kind") == "absent", F.concat(F.lit("NOT "), operand)).otherwise(operand)
    after_first = F.when(first_field == "", F.col("stripped")) \
        .otherwise(F.substring("stripped", F.char_length(first_field) + 2, 1 << 30))
    c = c.select(
        "request_id", "clause_no", "kind",
        F.when(first_field == "", F.lit(None).cast("string")).otherwise(first_field).alias("field"),
        after_first.alias("text"), "is_prefix",
        rendered.alias("rendered"),
        # operand renders to nothing, a bare '*', a field with nothing after it,
        # or a field filter applied twice: the whole expression is rejected.
        ((operand == "") | (operand == "*") | ((prefixes != "") & (rest == ""))
         | (F.char_length(prefixes) > F.char_length(first_field) + 1)).alias("bad"),
    )
    return c


def request_meta(requests: DataFrame, clause_df: DataFrame | None = None,
                 allowed_fields: tuple[str, ...] = ("title", "doc")) -> DataFrame:
    """Per request: n_required, n_optional, n_absent and ``valid``."""
    c = clause_df if clause_df is not None else clauses(requests)
    not_allowed = F.col("field").isNotNull() & ~F.col("field").isin(*allowed_fields)
    agg = c.groupBy("request_id").agg(
        F.sum(F.when(F.col("kind") == "required", 1).otherwise(0)).cast("bigint").alias("n_required"),
        F.sum(F.when(F.col("kind") == "optional", 1).otherwise(0)).cast("bigint").alias("n_optional"),
        F.sum(F.when(F.col("kind") == "absent", 1).otherwise(0)).cast("bigint").alias("n_absent"),
        F.max(F.col("bad") | not_allowed).alias("any_bad"),
    )
    return (requests.select("request_id").join(agg, "request_id", "left")
            .select("request_id",
                    F.coalesce("n_required", F.lit(0)).alias("n_required"),
                    F.coalesce("n_optional", F.lit(0)).alias("n_optional"),
                    F.coalesce("n_absent", F.lit(0)).alias("n_absent"),
                    ((F.coalesce("n_required", F.lit(0)) + F.coalesce("n_optional", F.lit(0)) > 0)
                     & ~F.coalesce("any_bad", F.lit(False))).alias("valid")))


def canonical_query(requests: DataFrame) -> DataFrame:
    """The boolean match text a request stands for (operands in reverse order)."""
    c = clauses(requests)

    def joined(kind: str, sep: str):
        items = F.collect_list(F.when(F.col("kind") == kind, F.struct(
            F.col("clause_no"), F.col("rendered"))))
        ordered = F.reverse(F.array_sort(items))
        return F.array_join(F.transform(ordered, lambda s: s["rendered"]), sep).alias(kind)

    g = c.groupBy("request_id").agg(joined("optional", " OR "), joined("required", " AND "),
                                    joined("absent", " "))
    o, r, a = F.col("optional"), F.col("required"), F.col("absent")
    # Presence is decided by clause counts, not text (an operand may render empty).
    cnt = c.groupBy("request_id").agg(
        F.sum(F.when(F.col("kind") == "optional", 1).otherwise(0)).alias("no"),
        F.sum(F.when(F.col("kind") == "required", 1).otherwise(0)).alias("nr"),
        F.sum(F.when(F.col("kind") == "absent", 1).otherwise(0)).alias("na"))
    g = g.join(cnt, "request_id")
    ho, hr, ha = F.col("no") > 0, F.col("nr") > 0, F.col("na") > 0
    expr = (F.when(~hr & ~ha & ho, o)
            .when(hr & ~ha & ~ho, r)
            .when(hr & ~ha & ho, F.concat(F.lit("("), o, F.lit(") AND "), r))
            .when(~hr & ha & ho, F.concat(F.lit("("), o, F.lit(")  "), a))
            .when(hr & ha & ho, F.concat(F.lit("("), o, F.lit(") AND "), r, F.lit(" "), a))
            .when(hr & ha & ~ho, F.concat(r, F.lit(" "), a))
            .otherwise(F.lit("")))
    return (requests.select("request_id").join(g.select("request_id", expr.alias("expression")),
                                                "request_id", "left")
            .select("request_id", F.coalesce("expression", F.lit("")).alias("expression")))


def random_workload(vocab_terms: DataFrame, package_names: DataFrame, n_requests: int,
                    seed: int = 42, max_words: int = 3, max_packages: int = 5) -> DataFrame:
    """seeded random requests of distinct words and distinct packages.

    ``vocab_terms(term)`` and ``package_names(package)`` are pick-lists of tens of rows.
    A request draws 1..max_words words and 1..max_packages packages, or all if the list is
    shorter: it orders a list by a digest of (seed, request, entry) and takes the first ones.
    """
    reqs = vocab_terms.sparkSession.range(n_requests).withColumnRenamed("id", "request_id")

    def digest(*parts) -> Column:
        return F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("request_id").cast("string"), *parts))

    def draw(entries: list[str], most: int, glue: str, name: str) -> Column:
        listed = F.array(*[F.struct(digest(F.lit(e)).alias("h"), F.lit(e).alias("e")) for e in entries])
        count = F.conv(F.substring(digest(F.lit(f"{name} count")), 1, 8), 16, 10).cast("bigint") % most + 1
        first = F.slice(F.array_sort(listed), 1, count.cast("int"))
        return F.array_join(F.transform(first, lambda s: s["e"]), glue).alias(name)

    words = [r["term"] for r in vocab_terms.select("term").collect()]
    packages = [r["package"] for r in package_names.select("package").collect()]
    return reqs.select("request_id", draw(words, max_words, " ", "q"), draw(packages, max_packages, ",", "packages"))
