"""Counterfactual-pair bias analytics on Spark.

Every public operator takes and returns a :class:`pyspark.sql.DataFrame`; keys are explicit
columns (``pair_id``, ``side``, ``seed_rank``) instead of list positions, so the work partitions and
shuffles like any Spark SQL job.
"""

__version__ = "0.1.0"
