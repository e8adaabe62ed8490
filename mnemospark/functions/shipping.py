"""Python workers import this package; where they wouldn't find it, the session hands it to them."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Give the package's sources to the executors, once a context; nothing to do where they are on the workers' path."""
    sc = spark.sparkContext
    path = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if getattr(sc, "_mnemospark", False) or str(ROOT) in path or Path.cwd() == ROOT:
        return
    name = f"{tempfile.mkdtemp(dir=sc._temp_dir)}/mnemospark.zip"  # goes with the context, whose file server reads it
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted((ROOT / "mnemospark").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(name)
    sc._mnemospark = True
