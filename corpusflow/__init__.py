"""corpusflow: training-data and evaluation analytics as Spark DataFrame operators.

Every public operator is a function ``DataFrame -> DataFrame`` (or a Column
expression) built from Spark SQL primitives, so Catalyst plans it and the work
is partitioned and shuffled by Spark.
"""

__version__ = "0.1.0"
