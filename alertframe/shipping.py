"""Makes this package importable in Python workers that weren't started beside it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the application's files, once."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    made = Path(tempfile.mkdtemp()) / "alertframe_src.zip"
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*")):
            if p.suffix in (".py", ".json", ".yaml") and "__pycache__" not in p.parts:
                z.write(p, p.relative_to(here.parent))
    sc.addPyFile(str(made))
    _shipped.add(sc.applicationId)
