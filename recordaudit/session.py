"""Session helpers: the time zone, and tables written to the cluster's shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_test_dirs: dict[str, str] = {}
_shipped: set[str] = set()
_tables: dict[str, list[str]] = {}
_releases = 0


def pin_utc(spark: SparkSession) -> None:
    """All timestamps are UTC, so epoch seconds and date parts must not depend on the host."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``, else the context's checkpoint dir.

    Only a local-mode session (tests) may fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if context.applicationId not in _test_dirs:
        _test_dirs[context.applicationId] = tempfile.mkdtemp(prefix="recordaudit-")
    return _test_dirs[context.applicationId]


def written(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives executor loss, and gives Catalyst the true file size, so that a
    join against the table is broadcast only when it really is below the broadcast threshold.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/recordaudit/{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _tables.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, written; the tables that it wrote meanwhile are deleted. Nothing else may write tables at the same time."""
    before = len(_tables.get(spark.sparkContext.applicationId, []))
    result = written(make())
    own = _tables[spark.sparkContext.applicationId]
    _deleted(spark, own[before:-1])
    del own[before:-1]
    return result


def _deleted(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables this application has written. Call it when results that were made from them
    have been read or stored; a result is lazy and needs its tables until then."""
    global _releases
    _releases += 1
    _deleted(spark, _tables.pop(spark.sparkContext.applicationId, []))


def releases() -> int:
    """Number of releases so far: what was kept from before the last one is gone."""
    return _releases


def range_count(spark: SparkSession) -> int:
    """Number of value ranges for two-level prefix sums: follows the session's parallelism."""
    return max(16, min(8192, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that tasks can import it from anywhere."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="recordaudit-"), "recordaudit_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as bundle:
        for folder, _, names in os.walk(top):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                bundle.write(path, os.path.relpath(path, os.path.dirname(top)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)
