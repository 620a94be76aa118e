"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; only a local master without that setting uses a folder of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        named = _LOCAL.setdefault(app, "") or _LOCAL.update({app: "file://" + tempfile.mkdtemp(prefix="sievegate-")}) or _LOCAL[app]
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"
