"""Making this package importable on the executors, and cutting lineage in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors once a Spark context; Spark's own file server carries them."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():
        folder = tempfile.mkdtemp(prefix="tessera-src-")  # on the driver, served from there until it ends
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = Path(folder, "tessera_src.zip")
        with zipfile.ZipFile(path, "w") as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, str(source.relative_to(root.parent)))
        sc.addPyFile(str(path))
    sc._tessera_shipped = True


def cut(df: DataFrame) -> DataFrame:
    """Eager checkpoint in the folder that spark.checkpoint.dir names; only where it is unset and Spark runs in one process
    (tests) a folder is made.  Files go with their tables where spark.cleaner.referenceTracking.cleanCheckpoints is true."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-"))
    return df.checkpoint()
