"""Sends this package to the executors, so that Python functions of it run there without an installed copy."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the session's files, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    target = Path(tempfile.mkdtemp(prefix="spark-")) / f"{ROOT.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(ROOT.rglob("*.py")):
            out.write(path, path.relative_to(ROOT.parent))
    context.addPyFile(str(target))
    _SENT.add(context.applicationId)
