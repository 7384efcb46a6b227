"""Session factory with the settings every operator expects (UTC, ANSI, adaptive execution)."""

from __future__ import annotations

import os
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Set only where the caller's cluster has not set them.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(name: str = "quillspan", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the submitter's own session is used as it is."""
    builder = SparkSession.builder.appName(name).master(f"local[{cpus or '*'}]")
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(cpus or os.cpu_count() or 8), "spark.driver.memory": "8g"} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession, archive: str) -> None:
    """Zip the package to ``archive`` and add it to the executors' Python path (where it is not installed there)."""
    root = Path(__file__).resolve().parent
    with zipfile.ZipFile(archive, "w") as z:
        for p in root.rglob("*.py"):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(archive)
