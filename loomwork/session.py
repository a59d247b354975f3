"""Session helpers: building a session, shipping the package, cutting lineage."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: dict[str, str] = {}


def build_session(cpus: int | str = "*", app: str = "loomwork", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the engine is written for."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers once per application.

    Workers import UDF bodies by module name; the checkout need not be on their
    path, neither on a cluster nor when a local driver was started elsewhere.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    folder = tempfile.mkdtemp(prefix="loomwork-ship-")
    target = os.path.join(folder, "loomwork_pkg.zip")
    Path(target).write_bytes(buffer.getvalue())
    sc.addPyFile(target)
    _shipped[sc.applicationId] = target


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the session's ``spark.checkpoint.dir``; a
    temporary one only where that is unset and the master is local (tests)."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="loomwork-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """``df`` written as a table into the shared checkpoint folder and read back.

    This drops the lineage and, unlike ``checkpoint()``, the size estimates that
    joins multiply from round to round of a loop. The files survive the loss of
    executors and go when the application ends, or earlier when a later table
    ``replaces`` them. Keep the frame narrow: ids and numbers, never whole texts.
    """
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(path)
    if replaces is not None and (old := getattr(replaces, "_cut_folder", None)):
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(old), True)
    back = spark.read.schema(df.schema).parquet(folder)
    back._cut_folder = folder
    return back


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
