"""Sessions, the shared working folder, and tables written to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN_DIRS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def build_session(app: str = "lodestone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; conf overrides any of it."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only where the setting is missing on one machine (as in tests) a temporary folder is made, once for each application; on a
    cluster, where executors wouldn't share it, that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return _OWN_DIRS[app]


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing has used; deleted when the driver ends."""
    path = f"{shared_dir(spark)}/lodestone/{tag}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    except Exception:  # the JVM may be gone already
        pass


def written(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
    """df written to the shared folder and read back: later steps neither recompute it nor depend on an executor's disk."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python workers this package, once for each application; it needn't be installed there."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="lodestone-")) / "lodestone.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    atexit.register(shutil.rmtree, archive.parent, True)
    spark.sparkContext.addPyFile(str(archive))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
