"""Session factory with the settings the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that hold on a laptop and on a cluster alike; sizes come from the deployment.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "siltworks", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS; keyword settings use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        cores = master.partition("[")[2].rstrip("]") or "1"
        n = os.cpu_count() if cores == "*" else int(cores)
        b = b.master(master).config("spark.sql.shuffle.partitions", str(n))
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
