"""The package on the executors' Python path, for operators that run Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application; Spark passes it on to later ones too."""
    sc = spark.sparkContext
    if getattr(sc, "_orgweave_shipped", False):
        return
    root = Path(__file__).parent
    path = os.path.join(tempfile.mkdtemp(prefix="orgweave-"), "orgweave_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(path)
    sc._orgweave_shipped = True
