"""Makes this package importable on executors that don't have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Bytes of an Arrow batch: what a task holds outside the heap, several times over, while texts go to Python and back.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors, once per application.

    Spark's own file server carries the archive, so no shared disk is needed. Arrow batches
    are kept small, unless the application's configuration sets their size.
    """
    sc = spark.sparkContext
    if not sc.getConf().contains(BATCH_SETTING):
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    if getattr(sc, "_lodeframe_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="lodeframe-src-"), "lodeframe.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    sc.addPyFile(path)
    sc._lodeframe_shipped = True
