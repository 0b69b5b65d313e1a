"""Making this package importable in the executors' Python."""

from __future__ import annotations

import tempfile
import zipfile
from functools import lru_cache
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once an application; call it before Python tasks."""
    _ship(spark.sparkContext.applicationId, spark)


@lru_cache(maxsize=8)
def _ship(application: str, spark: SparkSession) -> None:
    package = Path(__file__).resolve().parents[1]
    with tempfile.NamedTemporaryFile(prefix=f"{package.name}-", suffix=".zip", delete=False) as f:
        with zipfile.ZipFile(f, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(f.name)
