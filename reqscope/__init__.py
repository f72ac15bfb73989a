"""reqscope: labelled-text preparation and binary classifier evaluation on Spark.

Every operator is a ``DataFrame -> DataFrame`` function built from Spark SQL
expressions, windows, joins and ML pipelines, usable with ``df.transform``.
"""

__version__ = "0.1.0"
