"""Gives Python workers this package, wherever the driver has it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Spark's own bound on a batch that goes to a Python worker, and the one set here. Texts can be long, and each worker of an executor holds a batch.
BATCH, DEFAULT, LESS = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once for each application: workers import functions of it by name. Batches to workers are bounded by LESS, unless the session has a bound of its own."""
    if spark.conf.get(BATCH, DEFAULT) == DEFAULT:
        spark.conf.set(BATCH, LESS)
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp()  # the driver's own copy; executors fetch it from the driver
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "tessera_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tessera", os.path.relpath(full, top)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
