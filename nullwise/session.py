"""Session helpers.

The library never creates a session behind the caller's back except in
``get_spark`` (tests, bench, local runs).  Everything else takes the
caller's session and reads settings from it.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app: str = "nullwise") -> SparkSession:
    """Local session for tests and the bench; on a cluster use your own."""
    master = master or os.environ.get("NULLWISE_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("NULLWISE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder; set a scratch one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is.  Only an unset session (local tests) gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="nullwise-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs the running stage only, and
    later scans read the columns they need instead of computing them again.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discarded(df: DataFrame) -> None:
    """Delete a table of ``stored`` that no later step reads."""
    sc = df.sparkSession.sparkContext
    for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


_shipped: set[str] = set()


def make_importable(spark: SparkSession) -> None:
    """Let the Python workers find this package, wherever the driver was started.

    Workers that inherit a PYTHONPATH with the package need nothing.  Local
    workers get the folder by their environment; a cluster's executors fetch
    a zip of the package from the driver, once per application.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        sc.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, sc.environment.get("PYTHONPATH")]))
    else:
        sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "nullwise"), "zip", root, "nullwise"))
