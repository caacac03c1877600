"""Session helper used by tests, the benchmark and the examples."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, app: str = "quadrill", **conf: str) -> SparkSession:
    """A local session; ``spark.checkpoint.dir`` and cluster settings are left to the caller."""
    settings = {
        "spark.sql.shuffle.partitions": str(cores if isinstance(cores, int) else 8),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
    } | conf
    return SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()
