"""Making the package importable in the Python workers of any cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_NAME = "taproot-package.zip"


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application; Spark itself distributes the archive."""
    sc = spark.sparkContext
    if any(name.endswith(_NAME) for name in getattr(sc, "_python_includes", [])):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), _NAME)
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, files in os.walk(root):
            for file in files:
                if file.endswith(".py"):
                    full = os.path.join(folder, file)
                    archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
