"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import re
import uuid

from pyspark import cloudpickle
from pyspark.sql import SparkSession

# UTC everywhere: day partitions, document days and epoch conversions must not
# depend on the zone of the machine that happens to run a task.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "harrow", master: str | None = None,
                  conf: dict[str, str] | None = None) -> SparkSession:
    ship_code()
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_code() -> None:
    """Send the package's own functions along with the tasks that run them.

    Executors then need no copy of the package.
    """
    import harrow

    cloudpickle.register_pickle_by_value(harrow)


def use_utc(spark: SparkSession) -> SparkSession:
    """Pin the zone on a session somebody else built."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder every executor can reach.

    The cluster names the base in ``spark.checkpoint.dir``; where that is
    unset the warehouse folder is used, unless it lies on this machine's disk while
    the executors are elsewhere.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_harrow"
        refuse_local(spark.sparkContext.master, base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def refuse_local(master: str, base: str) -> None:
    """Raises if a folder of this machine were to be shared with executors on others."""
    if not re.match(r"local(\[|$)", master) and re.match(r"(file:|/|[^:/]+(/|$))", base):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; {base} is local")


def set_checkpoint_dir(spark: SparkSession) -> None:
    """Let ``DataFrame.checkpoint`` use the shared base; keep one already set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark, "rdd"))
