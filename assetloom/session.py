"""Make the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package's sources along with the application, unless the workers find them by ``PYTHONPATH`` or the working directory.

    Where the package is installed on the cluster or given by ``--py-files`` this isn't needed.
    """
    context = spark.sparkContext
    paths = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if context.applicationId in _shipped or ROOT in paths or os.path.realpath(os.getcwd()) == os.path.realpath(ROOT):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="assetloom-"), "assetloom_sources.zip")
    with zipfile.ZipFile(archive, "w") as target:
        for folder, _, names in os.walk(os.path.join(ROOT, "assetloom")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    target.write(path, os.path.relpath(path, ROOT))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
