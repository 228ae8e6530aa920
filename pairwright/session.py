"""Sessions with the settings that results depend on."""

from pyspark.sql import SparkSession


def session(cores: str = "*") -> SparkSession:
    return SparkSession.builder.master(f"local[{cores}]").appName("pairwright").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.sql.adaptive.enabled", "true").getOrCreate()
