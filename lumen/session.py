"""Session with the settings that the engine assumes."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("lumen")
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def workers_import(spark: SparkSession) -> SparkSession:
    """spark, whose Python workers look for this package where the driver has it, whatever folder the session was started in; where executors have it installed, nothing changes."""
    root, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*filter(None, paths), root])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset (tests on one machine), below a temporary folder that the session keeps."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lumen-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lumen-{uuid.uuid4().hex}"
