"""Getting this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


#: Rows of a batch for Python workers where the session sets no number: texts of a few KB make batches of
#: some MB, in the JVM and in the worker.
BATCH_ROWS = "2000"


def ship(spark: SparkSession) -> None:
    """Adds the package to the application's Python files, once, so that workers can import it
    whatever their working directory and PYTHONPATH are, and bounds batches where nothing else does."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).parent
    path = Path(os.path.realpath(tempfile.mkdtemp(prefix="tidelog-ship-"))) / "tidelog_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, f"{root.name}/{file.relative_to(root)}")
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)
