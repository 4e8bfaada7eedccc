"""Sends this package to the executors of a session, where it may not be installed."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the Python path of all executors, once per application.

    The driver serves the file for as long as it lives, so it is deleted at exit."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    _sent.add(context.applicationId)
    root = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="tessera-")).resolve()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(folder / "tessera.zip", "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(folder / "tessera.zip"))
