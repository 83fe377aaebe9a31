"""The package itself, sent to the Python workers of a session.

Functions that run in executors import this package; a worker finds it by the
session's Python files, wherever the driver was started."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if not os.path.isdir(root):  # it came out of such an archive itself
        return
    at = os.path.join(tempfile.mkdtemp(prefix="inkloom-code-"), "inkloom.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, files in sorted(os.walk(root)):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(at)
    _sent.add(sc.applicationId)
