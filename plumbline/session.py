"""Session settings and durable cut points."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on: runtime re-planning splits skewed join
# partitions and turns a shuffled join into a broadcast one only after the
# real size of a side is known.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "plumbline", master: str | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings above; ``extra`` overrides any of them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**ENGINE_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def durable_dir(spark: SparkSession) -> str:
    """The shared folder for cut points.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset in a
    local session a temporary folder is chosen; executors of a cluster could not
    see it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    chosen = tempfile.mkdtemp(prefix="plumbline-cut-")
    spark.sparkContext.setCheckpointDir(chosen)
    return chosen


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage once and read it from there afterwards.

    Used where re-running the upstream work would be wrong or costly, such as
    calls to a model: a lost executor then never repeats them.
    """
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(durable_dir(spark))
    return df.checkpoint(eager=True)


_shipped: set[tuple[str, str]] = set()


def ship(spark: SparkSession, *packages: Path) -> None:
    """Give executors the source packages their Python tasks import.

    Only needed where the packages are not installed on the cluster. Each
    package is sent once per application.
    """
    context = spark.sparkContext
    for package in packages:
        if (context.applicationId, str(package)) in _shipped:
            continue
        base = Path(tempfile.mkdtemp(prefix="plumbline-src-")) / package.name
        context.addPyFile(shutil.make_archive(str(base), "zip", package.parent, package.name))
        _shipped.add((context.applicationId, str(package)))
