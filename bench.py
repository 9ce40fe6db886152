"""Benchmark: prints one JSON line with per-query wall times.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REQUESTS (default 2000).

Workload (the reference's benchmark shape, drawn from our data): each request
has 1-3 words out of the 13 most common vocabulary terms and 1-4 packages out
of the 4 most downloaded, seeded. The index is built once (timed), then the
whole batch is answered by one search job and one autocomplete job. Results
are executed through the ``noop`` sink so timing covers the full plan without
collecting to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
N_REQ = int(os.environ.get("BENCH_REQUESTS", "2000"))


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    from folio.operators import rank as RK
    from folio.operators import requests as R
    from folio.plans import index as IX
    from folio.plans.catalog import QUERIES, autocomplete_corpus
    from folio.plans.search import autocomplete, search, with_excerpts
    from folio.operators.requests import random_workload
    from folio.session import get_spark
    from folio.sources import testdata as D

    spark = get_spark(master=f"local[{CPUS}]", shuffle_partitions=int(CPUS) * 2)
    times: dict[str, float] = {}
    extra: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.time()
        fn()
        times[name] = round(time.time() - t0, 3)

    docs = D.docs(spark, SF_DIR)
    path = IX.scratch_path(spark, "bench-index")
    timed("index_build", lambda: (IX.build_search_index(docs, path), IX.build_title_index(docs, path),
                                  IX.build_autocomplete_index(autocomplete_corpus(docs), path)))
    table = lambda name: IX.read_index(spark, path, name)
    extra["index_postings_per_sec"] = round(table("postings").count() / max(times["index_build"], 1e-9), 1)

    # Pick-lists derived from the data: the most common terms, the largest packages.
    terms = table("vocab").groupBy("term").agg(F.sum("docs").alias("doc")).orderBy(F.desc("doc"), "term").limit(13)
    names = D.search_packages(spark, SF_DIR).orderBy(F.desc("recent_downloads"), "name").limit(4)
    reqs = random_workload(terms, names.select(F.col("name").alias("package")), N_REQ, seed=42).cache()
    reqs.count()

    def do_search():
        res = search(reqs, table("docs"), table("postings"), terms=table("terms"), vocab=table("vocab"))
        run(with_excerpts(res, reqs, table("docs"), table("postings"), vocab=table("vocab")))

    def do_autocomplete():
        run(autocomplete(reqs, table("docs"), titles=table("titles"), tri_index=table("trigrams"), tri_counts=table("tricounts")))

    def do_weighted(batch):
        # The baseline's query shape: title-trigram BM25 over the autocomplete
        # corpus, ordered by rank / 5 - downloads div 1,000,000, top 10 per request.
        c = R.clauses(batch)
        meta = R.request_meta(batch, c, allowed_fields=("title",))
        ranks = RK.bm25_trigram(table("atitles"), c, meta, tri_index=table("atrigrams"), tri_counts=table("atricounts"))
        rows = RK.blend_rows(ranks, table("docs"), D.search_packages(spark, SF_DIR), -1)
        run(RK.blend_downloads(rows, 5.0, 1_000_000, 10))

    timed("search_batch", do_search)
    timed("autocomplete_batch", do_autocomplete)
    timed("weighted_autocomplete_batch", lambda: do_weighted(reqs))
    timed("weighted_autocomplete_single", lambda: do_weighted(reqs.limit(1)))
    for name in ("search_batch", "autocomplete_batch", "weighted_autocomplete_batch"):
        extra[name.replace("_batch", "_ms_per_request")] = round(1000 * times[name] / N_REQ, 2)
    extra["search_requests_per_sec"] = round(N_REQ / max(times["search_batch"], 1e-9), 1)
    extra["autocomplete_requests_per_sec"] = round(N_REQ / max(times["autocomplete_batch"], 1e-9), 1)

    # The registered queries read an index of their own, built once a session: before their timers.
    from folio.plans.catalog import index_path
    t0 = time.time()
    for stem, kind in ((False, "search"), (True, "search"), (False, "titles"), (False, "autocomplete")):
        index_path(spark, SF_DIR, stem, kind)
    extra["query_indexes_sec"] = round(time.time() - t0, 3)

    for name in ["search_stemmed", "search", "autocomplete", "bm25", "blend_distance", "pruned_walk", "name_groups",
                 "knn_exact", "vocabulary", "spell_candidates", "ingest_repair"]:
        timed(name, lambda n=name: run(QUERIES[n](spark, SF_DIR)))

    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_wall_time", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(SF_DIR.rstrip("/")).replace("sf", ""),
                      "requests": N_REQ, **extra}))


if __name__ == "__main__":
    main()
