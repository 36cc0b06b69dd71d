"""Sends this package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent.parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the context, once: Python workers of any machine can then import it."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    path = Path(tempfile.mkdtemp(prefix="ledgerloom-")) / "ledgerloom_package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    sc.addPyFile(str(path))
    _sent.add(sc.applicationId)
