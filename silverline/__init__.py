"""silverline: a Spark-native data-curation lakehouse.

Every public operator is a function from Spark DataFrames (plus plain
parameters) to a Spark DataFrame, built from Catalyst expressions, SQL and
Structured Streaming.  Sub-packages:

* ``functions``  Column -> Column scalar expressions (text repair, patterns, typed parsing)
* ``operators``  DataFrame -> DataFrame operators (profiling, integrity, provenance,
  search, metering, catalog, routing, context packing, as-of join)
* ``sources``    readers and writers (CSV/JSON/Parquet/whole text/markup, partitioned sinks)
* ``plans``      compositions (clean, promote), derived fixture tables and the query registry
* ``streaming``  Structured Streaming jobs (incremental ingest, rate windows, live counters)
"""

__version__ = "0.1.0"
