"""Reading the driver's tables, shipping the package to executors, stored stages."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterdeck.session import cut_lineage

_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_TEXTS_PER_BATCH = 1000
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that tasks can import it.

    Spark's own file service carries the archive; the temporary copy is read by the driver only.
    """
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, str(path.relative_to(root.parent)))
    folder = tempfile.mkdtemp(prefix="package-")
    target = os.path.join(folder, f"{root.name}.zip")
    Path(target).write_bytes(packed.getvalue())
    spark.sparkContext.addPyFile(target)
    _shipped.add(application)


def prepare(spark: SparkSession) -> None:
    """Ship the package and bound the rows of a batch that Python workers receive."""
    ship_package(spark)
    # Rows hold whole texts: smaller batches than Spark's default keep Python workers small.
    if int(spark.conf.get(_BATCH_ROWS, "10000")) > _TEXTS_PER_BATCH:
        spark.conf.set(_BATCH_ROWS, str(_TEXTS_PER_BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored_with_row(frame: DataFrame, row: str = "_row") -> DataFrame:
    """Store a frame with a number per row, so that the numbers stay the same on every read."""
    return cut_lineage(frame.withColumn(row, F.monotonically_increasing_id()))
