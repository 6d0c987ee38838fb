"""Settings under which the library's plans run best."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: HotSpot never compiles a method above 8,000 bytes. Spark writes a whole stage as one method by default up to 65,535;
#: below this limit it falls back to expressions in methods of their own, which are compiled.
SETTINGS = {"spark.sql.codegen.hugeMethodLimit": "8000", "spark.sql.adaptive.enabled": "true"}


def tuned(builder: SparkSession.Builder) -> SparkSession.Builder:
    return builder.config(map=SETTINGS)
