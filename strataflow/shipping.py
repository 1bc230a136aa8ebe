"""Hands the package to Python workers that can't import it from their own path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application, adds the package as a zip file that the driver serves to the executors."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    package = Path(__file__).resolve().parent
    handle, name = tempfile.mkstemp(prefix="strataflow-", suffix=".zip")  # the driver's own copy, served by its file server
    with os.fdopen(handle, "wb") as file, zipfile.ZipFile(file, "w") as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, path.relative_to(package.parent))
    spark.sparkContext.addPyFile(name)
