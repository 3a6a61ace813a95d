"""What a session needs: the package in Python workers, and shared checkpoints."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once per Spark application.

    Spark's own file server distributes the archive, so executors need neither
    an installed copy nor a folder shared with the driver.
    """
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="photoflow-ship-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))
    _sent.add(context.applicationId)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read back, for tables that later passes read again.

    Files go to the folder of ``spark.checkpoint.dir``, which all executors
    share; only a local session without that setting gets a temporary one. A
    table is computed once, where a checkpoint computes it twice, and later
    passes read the columns that they need.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="photoflow-")
        context.setCheckpointDir(folder)
    path = f"{folder}/photoflow-{context.applicationId}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
