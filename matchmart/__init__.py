"""matchmart: match-data ingest, warehouse load and analytic marts on Spark.

Every public function takes and returns DataFrames (or a SparkSession plus
paths); no data set is collected to the driver, only status rows and bounded
partition metadata. Sub-packages:

- ``sources``    readers/writers: JSONL, JSON lists/maps, CSV, role views
- ``functions``  column expressions: exact numeric rounding, bins, text cleaning
- ``operators``  dedup, reshape, joins, quantiles, distributed NTILE, integrity, load
- ``plans``      the six marts, the batch ETL, versioned publishing, the shared-fact
                 refresh of all marts and incremental (histogram-state) refresh
- ``streaming``  resumable incremental ingest with Structured Streaming
"""

__all__ = ["sources", "functions", "operators", "plans", "streaming"]
