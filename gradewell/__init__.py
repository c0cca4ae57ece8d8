"""gradewell: evaluation analytics for code-generation benchmarks on Spark.

Layout: ``functions`` (Column -> Column), ``operators`` (DataFrame -> DataFrame),
``sources`` (readers and sinks), ``plans`` (views over the driver tables,
registered queries, oracle SQL), ``streaming`` (incremental metrics).
"""

__version__ = "0.1.0"
