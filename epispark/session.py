"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

LOCAL_MASTER = re.compile(r"local(\[[^\]]*\])?")
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A single hot customer, area or place is split at run time instead of landing in one task.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.session.timeZone": "UTC",
    # Files written by older tools carry nanosecond timestamps; read them as bigint and
    # let the schema aligner turn them into dates.
    "spark.sql.legacy.parquet.nanosAsLong": "true",
    "spark.ui.enabled": "false",
    # Recording the caller of every column expression costs seconds on large plans.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "epispark", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder of the cluster.

    Without that setting only a session whose master is known to run in this one process gets a
    folder of its own, as in tests; it is removed when the process ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not LOCAL_MASTER.fullmatch(spark.conf.get("spark.master", "")):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="epispark-")
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
