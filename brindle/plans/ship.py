"""Making this package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _done:
        return
    _done.add(sc.applicationId)
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="brindle-src-")
    target = os.path.join(folder, "brindle-src.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(target)
