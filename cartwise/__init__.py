"""cartwise — Spark-native retail basket and bundle analytics.

Every public operator is a function ``DataFrame -> DataFrame`` (or a small
family of them) built from Spark SQL / DataFrame expressions, so Catalyst
plans the whole lineage: scans are pruned and filtered at the Parquet
reader, joins are chosen by size statistics, and aggregates combine
map-side before they shuffle.
"""

__version__ = "0.1.0"
