"""riskflow: batch risk and collections analytics as Spark DataFrame jobs.

Layout
------
functions/  column-expression helpers (date boundaries, blank tests, logistic, geo)
operators/  reusable DataFrame operators (top-1 dedup, interval explode, pivots,
            running totals, binning, scoring, grading, conditional rollups)
sources/    readers (parquet tables, XML documents, delimited files) and sinks
plans/      the composed pipelines: collections list, delinquency x retry cost,
            feature engineering, scoring and grading, XML/TSV ingest
streaming/  incremental (micro-batch) form of the unseen-key append sink
"""

__version__ = "0.1.0"
