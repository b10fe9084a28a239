"""Gives a cluster's Python workers this package, where it is not installed on them."""

from __future__ import annotations

import os
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from blockmill.sources.tables import local_folder, shared_folder

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors, once for each application. The archive is written to the shared folder where that is a
    folder of files, and Spark hands it on from there; a session on one machine may do without."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        shared = (shared_folder(spark) or "").removeprefix("file://")
        if shared.startswith("/"):
            folder = os.path.join(shared, f"package-{context.applicationId}")
            os.makedirs(folder, exist_ok=True)
        else:
            folder = local_folder(spark, "package")
        archive = os.path.join(folder, f"{root.name}.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for path in sorted(root.rglob("*.py")):
                z.write(path, path.relative_to(root.parent))
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)
    return spark
