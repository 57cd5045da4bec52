"""Session settings the library relies on.

On a cluster the session comes from the platform (``spark-submit``, a notebook) and
only :func:`configure` is applied to it; :func:`local_session` is for tests and the
bench.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Runtime settings, safe to apply to a running session.  Partition counts are left to
# AQE: it coalesces small shuffles and splits skewed join partitions.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, app: str = "haloflux", memory: str = "8g") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        # plans here are wide; recording the Python call site of every column doubles the
        # time it takes to build them (static setting: only possible at session start)
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share; in local sessions without one, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        folder = f"file://{tempfile.mkdtemp(prefix='haloflux-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")
