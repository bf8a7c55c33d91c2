"""Makes the package importable on executors."""

from __future__ import annotations

import os
import tempfile
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent
_shipped: weakref.WeakSet = weakref.WeakSet()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context, unless their path has it anyway."""
    sc = spark.sparkContext
    if sc in _shipped or str(_ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    folder = tempfile.mkdtemp()
    archive = Path(folder) / f"{_ROOT.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, p.relative_to(_ROOT.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc)
