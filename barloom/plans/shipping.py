"""The package for Python workers that can't import it where they start."""

from __future__ import annotations

import os
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package along with the application's files, once, unless PYTHONPATH names its folder already."""
    app = spark.sparkContext.applicationId
    if app in _shipped or ROOT in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    import tempfile

    # staged by the driver alone; Spark takes it to the executors
    path = os.path.join(tempfile.mkdtemp(prefix="barloom-"), "barloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(os.path.join(ROOT, "barloom")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.relpath(full, ROOT))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
