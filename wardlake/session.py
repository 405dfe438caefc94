"""Session defaults for local runs and tests; on a cluster the given session is used as is."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

SHARED = "spark.checkpoint.dir"
_own: dict[str, str] = {}  # application -> folder, for sessions that name none


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  name: str = "wardlake") -> SparkSession:
    return (SparkSession.builder.master(f"local[{cores}]").appName(name)
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.adaptive.skewJoin.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.driver.memory", "8g")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config(SHARED, f"/tmp/{name}-{uuid.uuid4().hex}")
            .getOrCreate())


def use_local_scratch(spark: SparkSession) -> None:
    """For a session on one machine that names no shared folder: a folder in /tmp.

    Does nothing for other sessions; there ``scratch_dir`` asks for the setting.
    """
    context = spark.sparkContext
    if not spark.conf.get(SHARED, None) and context.master.split("[")[0] == "local":
        _own.setdefault(context.applicationId, f"/tmp/wardlake-{uuid.uuid4().hex}")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder for stream checkpoints and intermediate tables, below the shared folder."""
    shared = spark.conf.get(SHARED, None) or _own.get(spark.sparkContext.applicationId)
    if not shared:
        raise ValueError(f"set {SHARED} to a folder that the driver and all executors share")
    return f"{shared.rstrip('/')}/wardlake-{uuid.uuid4().hex}"
