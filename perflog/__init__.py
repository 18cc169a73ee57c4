"""perflog: entity-partitioned performance-log analytics on Spark.

Operators take column *roles* (see :class:`perflog.spec.LogSpec`) rather than
fixed names and return lazy DataFrames or Columns.  Everything runs as Spark
DataFrame plans; no Python UDF sits in a hot path.
"""

from perflog.spec import LogSpec

__all__ = ["LogSpec"]
