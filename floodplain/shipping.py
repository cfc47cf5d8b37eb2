"""Gives executors this package where their path doesn't hold it."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's source to the application's Python files, once, unless PYTHONPATH has it (as where it is installed)."""
    app = spark.sparkContext.applicationId
    if app in _shipped or str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for p in sorted((ROOT / "floodplain").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    path = Path(tempfile.mkdtemp(prefix="floodplain-code-")) / "floodplain.zip"
    path.write_bytes(raw.getvalue())
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
