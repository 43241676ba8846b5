"""What a session needs before Python code of this package runs on its executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_HERE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package's sources to the executors, once for each Spark application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        target = Path(tempfile.mkdtemp(prefix="tidewave")) / "tidewave_src.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(_HERE.rglob("*.py")):
                z.write(p, p.relative_to(_HERE.parent))
        sc.addPyFile(str(target))
        _shipped.add(sc.applicationId)
    return spark
