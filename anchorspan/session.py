"""Session helpers: local sessions for tests and benches, size-checked broadcast."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast by hint only if it has at most this many rows (counted, not guessed).
BROADCAST_ROWS = 200_000
#: And at most so many bytes in memory, where it is in hand.
BROADCAST_BYTES = 64 << 20


def local_session(cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that tests and bench.py share."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("anchorspan")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("ANCHORSPAN_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers of the session, wherever they run. Does so once per application."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="anchorspan-"), "anchorspan"), "zip", os.path.dirname(package), os.path.basename(package))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most ``rows`` rows. Reads no more than rows + 1 of them."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted size allows one; beyond it, df as it is (a shuffle join follows)."""
    return F.broadcast(df) if fits(df, rows) else df


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df taken in one job and broadcast, if it has at most ``rows`` rows and ``size`` bytes; beyond that df as it is (a shuffle join follows).

    For a side that is costly to find and small in the end, such as one row per file: it is found once, not again in the plan.
    """
    taken = df.limit(rows + 1).toArrow()
    if taken.num_rows > rows or taken.nbytes > size:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(taken, df.schema))
