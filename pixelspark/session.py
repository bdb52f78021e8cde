"""Session helpers: a local session for tests and benches, and sending the package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session on this machine with the settings that tests and benches share."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("pixelspark")
    settings = {
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_sent: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once an application, wherever their import path points."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="pixelspark-"), "pixelspark.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(archive)
    _sent.add(app)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` over all cores, for functions that work long on each row: a small file is one task, however long that
    takes. What comes in as many partitions as there are cores isn't shuffled."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(4 * cores, key)


def dealt(rows: DataFrame, key: str | None, per: int) -> DataFrame:
    """``rows`` by ``key`` (or in turn) in partitions of about ``per`` rows, no fewer than there are cores: for rows that
    become many each. A small file would be one task, and partitions of a fixed number would grow with the input. What
    groups, ranks or sorts by ``key`` and more afterwards isn't shuffled again."""
    n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // per))
    return rows.repartition(n, key) if key else rows.repartition(n)
