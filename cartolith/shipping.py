"""Sends this package to executors that cannot import it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as a Python file once a session, unless PYTHONPATH has it already."""
    context = spark.sparkContext
    on_path = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(":") if p]
    if context.applicationId in _sent or str(_ROOT) in on_path:
        return
    _sent.add(context.applicationId)
    archive = Path(tempfile.mkdtemp(prefix="cartolith-")) / "cartolith.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((_ROOT / "cartolith").rglob("*.py")):
            z.write(p, p.relative_to(_ROOT))
    context.addPyFile(str(archive))
