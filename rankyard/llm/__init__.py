"""Operations of a large training-data pipeline, each a Spark job with bounded state per task.

Nothing else in the package imports this subpackage.
"""
