"""Answering a stream of search requests (the service endpoints, re-aimed).

Request files (JSON lines ``{"request_id", "q", "packages"}``) arriving in a
folder are read with Structured Streaming. Each micro-batch is answered by
the same batch plan as ``folio.plans.search`` against a prebuilt index and
written to a folder of its own in the sink, so a batch that is run again
replaces its rows. Progress lives in the checkpoint location, so a restarted
query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio.operators.requests import REQUEST_SCHEMA
from folio.plans.index import read_index
from folio.plans.search import autocomplete, search, with_excerpts


def answer_stream(spark: SparkSession, requests_dir: str, index_path: str, sink_dir: str,
                  checkpoint: str, kind: str = "search", available_now: bool = True, stem: bool = False):
    """Start the streaming query; returns the ``StreamingQuery``. ``stem``: whether the index is stemmed."""
    stream = spark.readStream.schema(REQUEST_SCHEMA).json(requests_dir)

    def answer(batch: DataFrame, batch_id: int) -> None:
        table = lambda name: read_index(spark, index_path, name)
        if kind == "search":
            found = search(batch, table("docs"), table("postings"), stem=stem, terms=table("terms"), vocab=table("vocab"))
            res = with_excerpts(found, batch, table("docs"), table("postings"), stem, vocab=table("vocab"))
        else:
            res = autocomplete(batch, table("docs"), titles=table("titles"), tri_index=table("trigrams"), tri_counts=table("tricounts"))
        res.write.mode("overwrite").parquet(f"{sink_dir}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")
    return writer.start()
