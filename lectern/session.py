"""Session helpers: building a session, shipping the package, shared scratch space."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution on; ``conf`` overrides any setting."""
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    return SparkSession.builder.master(master).config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Give every executor this package once per application, so that workers need no shared install."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(prefix="lectern-ship-"), "lectern.zip")
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(target)
        _shipped.add(sc.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a folder of its own; on a cluster that is an error, as no executor would see it.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lectern-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


_written: dict[str, object] = {}


def scratch_folder(spark: SparkSession) -> str:
    """A new path in the shared folder, whose files go with the driver process."""
    path = f"{shared_dir(spark)}/lectern/{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_discard_all)
    _written[path] = spark
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and no executor holds the only copy.

    Folders go when ``discard`` is called on the result, or with the driver process.
    """
    spark = df.sparkSession
    path = scratch_folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lectern_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release_shuffles(spark: SparkSession) -> None:
    """Have the driver notice plans that nothing holds any more, so that their shuffle files go."""
    spark._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Remove what ``materialise`` wrote for tables that nothing will read again, and let shuffle files go with it."""
    for t in tables:
        path = t._lectern_path
        _remove(_written.pop(path), path)
    if tables:
        release_shuffles(tables[0].sparkSession)


def _discard_all() -> None:
    for path, spark in _written.items():
        with contextlib.suppress(Exception):  # the driver's JVM may be gone
            _remove(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
