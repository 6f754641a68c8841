"""The library's own code for Python workers, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import ledgerlens

_shipped: set[str] = set()


def archive(path: str) -> str:
    """Writes the package's modules to a zip file that Python can import from."""
    package = os.path.dirname(os.path.abspath(ledgerlens.__file__))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as held:
        for folder, _, files in os.walk(package):
            for file in sorted(f for f in files if f.endswith(".py")):
                whole = os.path.join(folder, file)
                held.write(whole, os.path.relpath(whole, os.path.dirname(package)))
    return path


def ship(spark: SparkSession) -> None:
    """Has Spark send the library to all Python workers, once for each application; nothing needs to be installed there."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        context.addPyFile(archive(os.path.join(tempfile.mkdtemp(prefix="ledgerlens-"), "ledgerlens.zip")))
        _shipped.add(context.applicationId)
