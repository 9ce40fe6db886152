"""folio: documentation search analytics as Spark DataFrame jobs.

Subpackages: ``functions`` (column expressions and Arrow-batched helpers),
``operators`` (DataFrame -> DataFrame operators), ``sources`` (ingest and
test-data adaptors), ``plans`` (search/autocomplete plans, index build, the
registered driver queries), ``streaming`` (answering request streams).
"""

__version__ = "0.1.0"
