"""Website inventories, search metrics and text corpora as PySpark DataFrames."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path


def ship(spark) -> None:
    """Send this package to the executors' Python workers, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_siteindex_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="siteindex-"), "siteindex_package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, f"siteindex/{file.relative_to(root)}")
    context.addPyFile(path)
    context._siteindex_shipped = True
