"""Sending this package to executors that may not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_base_shipped", None) is None:
        root = Path(__file__).resolve().parents[1]
        archive = os.path.join(tempfile.mkdtemp(), "tidemark_base.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(archive)
        sc._tidemark_base_shipped = archive
