"""Index build and read.

An index is a set of parquet tables in a folder:

* ``postings/`` ``(package, id, col, term, tf, places)``, each distinct term of a column once with its places,
  partitioned by ``package`` and sorted by ``term`` inside each file, so a term lookup prunes partitions and
  row groups (min/max statistics). It is read as ``postings`` ``(package, id, col, pos, term)``, a row a place, or as
  ``terms`` ``(package, id, col, term, tf)``, without the places, for single-word clauses;
* ``lengths/`` ``(package, id, dl)``: tokens of every indexed row; ``vocab/`` ``(package, term, docs)`` for prefix expansion;
* ``docs/`` ``(package, id, ref, type, title, doc, lens, gaps, sentences, dl)`` partitioned by ``package``
  (bodies are stored once; postings refer to them by id; the layout of their tokens serves excerpts);
* ``titles/`` ``(package, id, ititle, ref, type)`` for autocomplete and
  ``trigrams/`` ``(package, id, tri)``, its trigram index, with ``tricounts/`` ``(package, tri, docs)``;
* ``atitles/`` ``(id, package, lt, dl)`` and ``atrigrams/`` ``(package, id, tri)``: the
  autocomplete corpus (B5) for title BM25.

Rows are range-partitioned on ``(package, term, id)`` (or ``(package, id)``): the sampled
borders split a package, and a term, that holds a large share of all rows over
many tasks, and every file covers a narrow, sorted range. Each build writes
new folders and becomes visible with one commit at the end: readers never see
half a build, nor packages of an earlier one. Rows that the title rules reject are
written to ``quarantine/`` with the reason: rows in = indexed + quarantined.

Upkeep (A7 into A11): ``digests/`` has a content digest of every row. ``update_index`` finds
new, changed and gone rows by them, cuts only new and changed ones into tokens, and commits a
*delta*: their tables, and ``tombstones/`` with the rows that earlier builds no longer speak
for. A table is then its last full build and the deltas since, each without what a later
tombstone names; the vocabulary's deltas are signed counts and are summed. ``compact_index``
writes that as a full build and removes the builds before it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.excerpt import LAYOUT
from folio.operators.analysis import indexable, quarantine, with_index_title
from folio.operators.cutting import term_places, with_cuts
from folio.operators.match import title_trigrams, trigram_counts
from folio.operators.rank import row_trigrams, trigram_rows
from folio.session import BROADCAST_ROW_LIMIT, bounded_broadcast, checkpoint_dir, cut_lineage, release, spread, written


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local on a cluster)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/folio-{name}-{uuid.uuid4().hex[:12]}"


class _Build:
    """Tables of one index build; ``commit`` makes them the current ones."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "full", **options):
        self.spark, self.path, self.version, self.tables = spark, path, uuid.uuid4().hex, []
        self.kind, self.options = kind, options

    def write(self, name: str, table: DataFrame, order: list[str], by: str | None = "package", dealt: bool = False) -> DataFrame:
        """``dealt``: the rows are dealt by range already."""
        laid = (table if dealt else table.repartitionByRange(*order)).sortWithinPartitions(*order).write
        (laid.partitionBy(by) if by else laid).parquet(f"{self.path}/{name}/{self.version}")
        del laid
        self.tables.append(name)
        release(self.spark)
        return self.spark.read.schema(table.schema).parquet(f"{self.path}/{name}/{self.version}")

    def together(self, *jobs: Callable[[], None]) -> None:
        """Submit jobs that do not depend on each other at once; the first error is raised."""
        with ThreadPoolExecutor(len(jobs)) as pool:
            for done in [pool.submit(job) for job in jobs]:
                done.result()

    def commit(self) -> None:
        """Take the next turn, or fail if another build has just taken it, and tell readers of the tables."""
        turn = max((c["turn"] for c in _commits(self.spark, self.path)), default=0) + 1
        if not _fs(self.spark, f"{self.path}/turns/{turn}", lambda fs, p: fs.createNewFile(p)):
            raise RuntimeError(f"another build of {self.path} took turn {turn}: build again")
        rows = [(t, self.version, turn, self.kind, json.dumps(self.options)) for t in self.tables]
        self.spark.createDataFrame(rows, "table string, version string, turn bigint, kind string, options string").coalesce(1) \
            .write.mode("append").parquet(f"{self.path}/commits")


def _fs(spark: SparkSession, name: str, action):
    """``action(file system, path)`` with the file system that ``name`` is on."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return action(path.getFileSystem(spark._jsc.hadoopConfiguration()), path)


def _commits(spark: SparkSession, path: str) -> list:
    """All commits, a row a table of a build: a handful for each build since the last compaction."""
    there = _fs(spark, f"{path}/commits", lambda fs, p: fs.exists(p))
    return spark.read.parquet(f"{path}/commits").orderBy("turn").collect() if there else []


def _chain(commits: list, table: str) -> list:
    """The last full build of a table and its deltas since."""
    own = [c for c in commits if c["table"] == table]
    last = max((c["turn"] for c in own if c["kind"] == "full"), default=None)
    return [c for c in own if last is not None and c["turn"] >= last]


def _selected(docs: DataFrame, packages: DataFrame | None) -> DataFrame:
    if packages is None:
        return docs
    return docs.join(packages.select(F.col("name").alias("package")), "package", "left_semi")


def _digests(docs: DataFrame) -> DataFrame:
    content = ["type", "title", "ref", "doc"]
    return docs.select("package", "id", F.xxhash64(*content).alias("d1"), F.xxhash64(F.lit(1), *content).alias("d2"),
                       F.concat(*[F.col(c).isNull().cast("string") for c in content]).alias("nulls"))


def _write_search_tables(build: _Build, docs: DataFrame, stem: bool, raw_titles: bool, partitioned: bool,
                         old_vocab: DataFrame | None = None) -> None:
    """The tables of ``docs``; ``old_vocab``: counts that a delta takes back."""
    by = "package" if partitioned else None
    order = ["package", "term", "id"] if partitioned else ["term", "package", "id"]
    title = "title" if raw_titles else "ititle"
    named = lambda rows: rows if raw_titles else with_index_title(rows)
    kept = ["package", "id", "ref", "type", "title", "doc"]
    # Dealt by range before they are cut: the sample of the borders then reads keys only, and the cut rows go straight to files.
    dealt = named((docs if raw_titles else indexable(docs)).select(*kept).repartitionByRange("package", "id"))
    rows = build.write("docs", with_cuts(dealt, title).select(*kept, *LAYOUT, "dl"), ["package", "id"], dealt=True)

    def of_postings() -> None:
        found = term_places(named(rows), title, by_package=partitioned, stem=stem)
        # Words of rows of one id are one term: put together where the range has brought them, without a further shuffle.
        merge = not rows.groupBy("package", "id").count().where("count > 1").isEmpty()
        if merge:
            found = written(found).repartitionByRange(*order).groupBy("package", "id", "col", "term").agg(
                F.sum("tf").alias("tf"), F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))
        found = build.write("postings", found, order, by, dealt=merge)
        vocab = found.groupBy("package", "term").agg(F.count(F.lit(1)).alias("docs"))
        if old_vocab is not None:
            vocab = vocab.unionByName(old_vocab.withColumn("docs", -F.col("docs"))).groupBy("package", "term").agg(F.sum("docs").alias("docs"))
        build.write("vocab", vocab, order[:2], by)

    def of_rows() -> None:
        build.write("lengths", rows.select("package", "id", "dl"), ["package", "id"], by)
        build.write("digests", _digests(docs), ["package", "id"], None)
        if not raw_titles:
            build.write("quarantine", quarantine(docs), ["package", "id"], None)

    build.together(of_postings, of_rows)


def build_search_index(docs: DataFrame, path: str, packages: DataFrame | None = None,
                       stem: bool = False, raw_titles: bool = False, partitioned: bool = True) -> None:
    """Write postings, terms, lengths, vocabulary, documents and quarantine
    for the selected packages (``partitioned=False``: one cross-package order, by term)."""
    docs = spread(_selected(docs, packages))
    options = {"stem": stem, "raw_titles": raw_titles, "partitioned": partitioned}
    build = _Build(docs.sparkSession, path, **options)
    _write_search_tables(build, docs, **options)
    build.commit()


def _write_titles(build: _Build, docs: DataFrame, with_ref: bool) -> None:
    t = indexable(docs).select("package", "id", "ititle", *(["ref", "type"] if with_ref else []))
    titles = build.write("titles", t, ["package", "id"])
    found = build.write("trigrams", title_trigrams(titles), ["package", "tri", "id"])
    build.write("tricounts", trigram_counts(found), ["package", "tri"])


def update_index(docs: DataFrame, path: str, packages: DataFrame | None = None, whole: bool = True) -> dict[str, int]:
    """Bring the search index (and the title index, if there is one) of ``path`` up to ``docs`` with a delta build.

    ``docs`` has each (package, id) once, both not null. With ``whole`` it is all there is, and rows of the index that it lacks are gone;
    else it is an upsert, which takes nothing away. Returns the rows that were ``new``, ``changed`` and ``gone``; only the first two
    are cut into tokens. Without a difference nothing is committed."""
    spark, docs = docs.sparkSession, _selected(docs, packages)
    chain = _chain(_commits(spark, path), "digests")
    options = json.loads(chain[0]["options"])
    old = read_index(spark, path, "digests").select("package", "id", *[F.col(c).alias(f"old_{c}") for c in ("d1", "d2", "nulls")])
    both = _digests(docs).withColumn("here", F.lit(True)).join(old, ["package", "id"], "full_outer" if whole else "left")
    same = (F.col("d1") == F.col("old_d1")) & (F.col("d2") == F.col("old_d2")) & (F.col("nulls") == F.col("old_nulls"))
    state = F.when(F.col("here").isNull(), "gone").when(F.col("old_d1").isNull(), "new").when(~same, "changed")
    moved = cut_lineage(both.select("package", "id", state.alias("state")).where("state is not null"))
    counts = {"new": 0, "changed": 0, "gone": 0} | {r["state"]: r["count"] for r in moved.groupBy("state").count().collect()}
    if not any(counts.values()):
        return counts
    fresh = bounded_broadcast(moved.where("state <> 'gone'").select("package", "id"))
    fresh = cut_lineage(spread(docs.join(fresh, ["package", "id"], "left_semi")))
    dead = moved.where("state <> 'new'").select("package", "id")
    n_dead = counts["changed"] + counts["gone"]
    build = _Build(spark, path, "delta", **options, tombstones=n_dead)
    taken = read_index(spark, path, "terms").join(_small(dead, n_dead), ["package", "id"], "left_semi") \
        .groupBy("package", "term").agg(F.count(F.lit(1)).alias("docs"))
    _write_search_tables(build, fresh, old_vocab=taken, **{k: options[k] for k in ("stem", "raw_titles", "partitioned")})
    if titles := _chain(_commits(spark, path), "titles"):
        _write_titles(build, fresh, json.loads(titles[0]["options"])["with_ref"])
    build.write("tombstones", dead, ["package", "id"], None)
    build.commit()
    return counts


def compact_index(spark: SparkSession, path: str) -> list[str]:
    """Write every table of ``path`` that has deltas as a full build, without what is gone, and remove the folders of builds that are
    no longer read; returns these. For a quiet time: a reader that started before may still need them."""
    commits = _commits(spark, path)
    tables = sorted({c["table"] for c in commits} - {"tombstones"})
    chains = {t: _chain(commits, t) for t in tables}
    build = None
    for t in (t for t in tables if len(chains[t]) > 1):
        options = json.loads(chains[t][0]["options"])
        build = build or _Build(spark, path)
        build.options |= options
        by = None if t in ("digests", "quarantine") or (t not in ("docs", "titles", "trigrams", "tricounts") and not options.get("partitioned", True)) else "package"
        now = trigram_counts(read_index(spark, path, "trigrams")) if t == "tricounts" else _stored(spark, path, t)
        order = [c for c in (["package", "term", "id"] if by else ["term", "package", "id"]) + ["tri"] if c in now.columns]
        build.write(t, now, order, by)
    if build:
        build.commit()
    live = {f"{c['table']}/{c['version']}" for t in tables for c in _chain(_commits(spark, path), t)}
    gone = sorted({f"{c['table']}/{c['version']}" for c in commits} - live)
    for name in gone:
        _fs(spark, f"{path}/{name}", lambda fs, p: fs.delete(p, True))
    return gone


def build_title_index(docs: DataFrame, path: str, packages: DataFrame | None = None,
                      with_ref: bool = True) -> None:
    """Normalised titles, with ref and type or without, per package, and their trigrams."""
    docs = spread(_selected(docs, packages))
    build = _Build(docs.sparkSession, path, with_ref=with_ref)
    _write_titles(build, docs, with_ref)
    build.commit()


def build_autocomplete_index(corpus: DataFrame, path: str) -> None:
    """The autocomplete corpus ``(id, package, atitle)`` for title BM25 and its trigrams, in one order over all packages."""
    build = _Build(corpus.sparkSession, path)
    rows = build.write("atitles", trigram_rows(cut_lineage(corpus)), ["id"], None)
    found = build.write("atrigrams", row_trigrams(rows), ["tri", "id"], None)
    build.write("atricounts", trigram_counts(found.withColumn("package", F.lit("*"))), ["tri"], None)
    build.commit()


#: Tables of counts a key: those of several builds are added up. Those of the vocabulary are exact, as deltas take counts
#: back; those of the trigrams, which only tell rare from frequent, keep what is gone until they are compacted.
SUMMED = {"vocab": "term", "tricounts": "tri"}


def _small(rows: DataFrame, n: int) -> DataFrame:
    """``rows``, known to be ``n``, broadcast within the bound."""
    return F.broadcast(rows) if n <= BROADCAST_ROW_LIMIT else rows


def read_index(spark: SparkSession, path: str, table: str = "postings",
               packages: list[str] | None = None) -> DataFrame:
    """Read the current state of an index table; a package list becomes a partition filter."""
    if table == "postings":
        return _stored(spark, path, table, packages).select("package", "id", "col", F.explode("places").alias("pos"), "term")
    if table == "terms":
        return _stored(spark, path, "postings", packages).select("package", "id", "col", "term", "tf")
    return _stored(spark, path, table, packages)


def _stored(spark: SparkSession, path: str, table: str, packages: list[str] | None = None) -> DataFrame:
    """The current state of a table as its files have it."""
    commits = _commits(spark, path)
    chain, parts = _chain(commits, table), []
    dead = [c for c in commits if c["table"] == "tombstones"]
    for c in chain:
        part = spark.read.parquet(f"{path}/{table}/{c['version']}") if c is chain[0] else \
            spark.read.schema(parts[0].schema).parquet(f"{path}/{table}/{c['version']}")
        if packages is not None:
            part = part.where(F.col("package").isin(packages))
        later = [d for d in dead if d["turn"] > c["turn"]]
        if later and table not in SUMMED:
            gone = reduce(DataFrame.unionByName, [spark.read.schema("package string, id bigint").parquet(
                f"{path}/tombstones/{d['version']}") for d in later]).distinct()
            part = part.join(_small(gone, sum(json.loads(d["options"])["tombstones"] for d in later)), ["package", "id"], "left_anti")
        parts.append(part)
    if not parts:
        raise ValueError(f"no table {table} in {path}")
    df = reduce(DataFrame.unionByName, parts)
    if table in SUMMED and len(parts) > 1:
        df = df.groupBy("package", SUMMED[table]).agg(F.sum("docs").alias("docs")).where("docs > 0")
    return df
