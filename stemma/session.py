"""Session, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("stemma")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one is set only where the session has none and runs on this machine alone."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="stemma-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


_CUTS: list[tuple[SparkSession, str]] = []


@atexit.register
def _forget() -> None:
    """Removes what cut() wrote once the driver ends in good order; later plans of a session may still read it before."""
    for spark, path in _CUTS:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session is gone; its folder is the cluster's to clean
            return


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back: short lineage, true size statistics, safe
    against lost executors. Call drop_cut on tables that no later plan reads."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stemma_path = path
    _CUTS.append((spark, path))
    return back


def drop_cut(df: DataFrame) -> None:
    path = getattr(df, "_stemma_path", None)
    if path:
        _delete(df.sparkSession, path)
        _CUTS[:] = [c for c in _CUTS if c[1] != path]


def partitions(spark: SparkSession) -> int:
    """Tasks for evenly spread Python work: what the session shuffles into, at least two per core."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(n, 2 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df in enough partitions to keep every core busy with Python work. Rows move only where the input has fewer
    partitions than the session has cores (a small file read by one task), or where what it joins is merged by size;
    large inputs are split already."""
    spark = df.sparkSession
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "Exchange" not in plan and df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(partitions(spark), *by)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, which need not see the repository; once a session. Spark's own file
    server hands the archive out."""
    sc = spark.sparkContext
    if getattr(sc, "_stemma_shipped", False):
        return
    root = Path(__file__).resolve().parent
    out = os.path.join(tempfile.mkdtemp(prefix="stemma-pkg-"), "stemma_pkg.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in root.rglob("*.py"):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(out)
    sc._stemma_shipped = True
