"""Session set-up for queries over long texts."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: texts that a Python worker gets at once; Spark's 10,000 may be many megabytes each way
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches, and add the package to the application's Python files, once.

    Spark serves those files to executors that don't have the package installed.
    """
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    parent = os.path.dirname(package)
    target = os.path.join(tempfile.mkdtemp(prefix="trapline-"), "trapline_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(package)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, parent))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)
