"""What the engine needs of a session: its own modules on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Rows of long texts make large Arrow batches; where the session keeps Spark's default, batches get smaller.
BATCHES = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"),)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application, and bound their batches."""
    for key, usual, value in BATCHES:
        if spark.conf.get(key, usual) == usual:
            spark.conf.set(key, value)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(package)
    path = os.path.join(tempfile.mkdtemp(prefix="kmerloom-"), "kmerloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), root))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
