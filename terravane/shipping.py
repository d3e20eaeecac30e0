"""Make the package importable in Python workers, wherever the driver was started from."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors once an application, unless their path already names this folder."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    archive = Path(tempfile.mkdtemp(prefix="terravane-src-")) / "terravane_src.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in [*sorted(ROOT.glob("terravane/**/*.py")), *ROOT.glob("corpus_pipeline.py")]:
            z.write(p, p.relative_to(ROOT))
    context.addPyFile(str(archive))
