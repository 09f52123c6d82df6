"""Session helpers shared by queries, tests and the bench."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "tallysheet") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TALLYSHEET_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` as the cluster names it.

    Only where it is unset, and all runs on one machine (tests, bench), a temporary folder is used.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told
    java = spark.sparkContext._jsc.sc().getCheckpointDir()
    if java.isDefined():
        return java.get()
    if not _one_machine(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "tallysheet-checkpoints")


def _one_machine(spark: SparkSession) -> bool:
    return re.match(r"local(\[|$)", spark.sparkContext.master) is not None


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder (survives lost executors)."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows spread by key over as many partitions as the session shuffles into.

    For stages whose work per byte is large: adaptive coalescing looks at bytes only and would put small
    inputs of costly rows into one task. A later aggregation by the same keys needs no other shuffle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


_WRITTEN: list[str] = []
_CLEARS: list[bool] = []


def _clear_at_end(spark: SparkSession) -> None:
    """Stages do not outlive the application that wrote them; one that was killed leaves its folder to the cluster."""
    try:
        if spark.sparkContext._jsc is not None:
            clear_written(spark)
    except Exception:  # the gateway is gone: nothing can be reached any more
        _WRITTEN.clear()


def clear_written(spark: SparkSession) -> None:
    """Delete the stages that this process has written; call it when nothing reads them any more, for instance
    between queries. The end of the application does so in any case."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        p = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        p.getFileSystem(conf).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a stage to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _WRITTEN and not _CLEARS:
        atexit.register(_clear_at_end, spark)
        _CLEARS.append(True)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """In local mode, make the package importable in Python workers where neither their path nor folder has it.

    A cluster gets the package with the job (``--py-files`` or its image).
    """
    root = Path(__file__).resolve().parent.parent
    app = spark.sparkContext.applicationId
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if app in _SHIPPED or not _one_machine(spark) or any(p and Path(p).resolve() == root for p in known):
        return
    path = Path(tempfile.mkdtemp(prefix="tallysheet-")) / "tallysheet.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "tallysheet").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
