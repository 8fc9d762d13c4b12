"""Sessions, table loading and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "lexstrata", memory: str = "8g") -> SparkSession:
    """A session for tests and bench.py on one machine. Cluster users bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_SHIPPED: set[str] = set()
_WRITTEN: dict[str, SparkSession] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application, wherever the driver has it from. Operators that run
    Python in workers call it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    if root.parent.suffix == ".zip" or not root.is_dir():  # came as an archive itself
        return
    out = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(out))  # served by the driver to every executor


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it. A folder of our own is used only where none is named and
    driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), f"lexstrata-{os.getuid()}"))
    return sc.getCheckpointDir()


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives the loss of executors, and gives
    the next plan true sizes. Used for intermediate results that several branches read. What is still there when the
    application's driver ends is removed then; ``release`` removes it before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lexstrata-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _WRITTEN:
        atexit.register(_clear)
    _WRITTEN[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._lexstrata_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Remove materialised frames that no later plan reads."""
    for df in frames:
        path = getattr(df, "_lexstrata_path", None)
        if path in _WRITTEN:
            _delete(_WRITTEN.pop(path), path)


def _clear() -> None:
    for path, spark in _WRITTEN.items():
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session has gone; the cluster clears its folder
            return
