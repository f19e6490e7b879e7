"""The folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile

from pyarrow import fs
from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder set here where it is unset (local masters, tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="maskweave-")
        spark.sparkContext.setCheckpointDir(where)
        where = spark.sparkContext.getCheckpointDir()
    return where


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder or file: a local one, or any that pyarrow reaches. Names are taken as they are."""
    if path.startswith("/") or path.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + re.sub(r"^(?:file:)?/+", "", path)
    store, rest = re.match(r"([A-Za-z][A-Za-z0-9+.-]*://[^/]*)(/.*)?$", path).groups()
    return fs.FileSystem.from_uri(store + "/")[0], (rest or "/") if store.startswith(("hdfs:", "viewfs:")) else store.partition("://")[2] + (rest or "")
