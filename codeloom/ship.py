"""Make this package importable for Python workers on any cluster."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once for each application, by Spark's own file server."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="codeloom-ship-")
    atexit.register(shutil.rmtree, folder, True)
    target = os.path.join(folder, "codeloom.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(target)
    _shipped[sc.applicationId] = target
