"""Session settings shared by the benchmark, the tests and the entry module."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, app: str = "evispark") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own settings."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("EVISPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    share_package(spark)
    return spark


_SHARED: set[str] = set()


def share_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of an application, once: Spark's file server ships it to each executor."""
    context = spark.sparkContext
    if context.applicationId in _SHARED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="evispark-"), "evispark.zip")  # on the driver; the server reads it as executors come
    with zipfile.ZipFile(archive, "w") as out:
        for root, _, files in os.walk(here):
            for path in (os.path.join(root, f) for f in sorted(files) if f.endswith(".py")):
                out.write(path, os.path.relpath(path, os.path.dirname(here)))
    context.addPyFile(archive)
    _SHARED.add(context.applicationId)
