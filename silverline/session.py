"""Session helpers: one SparkSession, the shared checkpoint folder, code for the executors."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "silverline") -> SparkSession:
    """Build (or return) a session configured for the library.

    ANSI mode stays on (Spark 4 default); the session zone is UTC so that
    ``TIMESTAMP`` values compare with DuckDB's zone-less timestamps; AQE with
    skew-join handling and partition coalescing is on.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SILVERLINE_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on, applied to any session (also the driver's)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package's code to the executors (once per application), for functions that run in Python workers."""
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="silverline-code-"), "silverline.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f"{top.name}/{f.relative_to(top)}")
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


_LOCAL_BASE: dict[int, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A folder under the cluster's shared ``spark.checkpoint.dir``.

    The setting is read from the session.  Only a local-mode session without
    the setting (tests, ad-hoc runs) gets a fresh temporary folder, remembered
    per SparkContext; a cluster session without it is an error, because a
    machine-local folder is not visible to other executors.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL_BASE.get(id(spark.sparkContext))
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder on this cluster")
        base = tempfile.mkdtemp(prefix="silverline-ckpt-")
        _LOCAL_BASE[id(spark.sparkContext)] = base
    return base.rstrip("/") + "/" + name


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` once as Parquet under the shared checkpoint folder, read it back.

    Unlike ``DataFrame.checkpoint`` (which recomputes an unpersisted plan to write
    its files) the plan runs exactly once; the files live in the cluster's shared
    folder, so a lost executor re-reads them instead of recomputing the lineage.
    Every call writes a fresh sub-folder; nothing is cleared.
    """
    import uuid

    path = shared_dir(df.sparkSession, f"{name}/{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
