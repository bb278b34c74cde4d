"""What a session needs to run this package on executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Give the executors this package, once an application: they may not have it on their path."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tarnflow-code-")) / f"{here.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(here.rglob("*.py")):
            z.write(path, path.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
