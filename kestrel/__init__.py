"""kestrel: a Spark-native binary classification pipeline.

Feature tables are DataFrames ``(row_id BIGINT, label DOUBLE, features ARRAY<DOUBLE>)``.
Relational steps (balance, moments, splits, metrics, arg-max, pivots) are Spark SQL;
fitted steps (Gram, SVM, sparse filter) run vectorised per partition and are summed.
"""

__version__ = "0.1.0"
