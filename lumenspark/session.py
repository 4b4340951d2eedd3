"""Session defaults used by tests, the bench and stand-alone programs."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "lumenspark") -> SparkSession:
    """A local session; on a cluster the submitter's own settings win."""
    return (
        SparkSession.builder.master(os.environ.get("LUMEN_MASTER", f"local[{cores}]"))
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LUMEN_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
