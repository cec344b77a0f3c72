"""Tables that are written once and read often, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir; where none is set a temporary one, in local mode only. It goes with the driver."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir is not set: executors share no other folder")
            shared = tempfile.mkdtemp(prefix="mnemospark-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        _folders[app] = f"{shared.rstrip('/')}/recall-{app}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folders[app])
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return _folders[app]


def written(df: DataFrame, name: str, order: tuple[str, ...] = ()) -> DataFrame:
    """df written and read back; in ranges and in order of some columns, so that a filter on them reads few row groups."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    held = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    # hashes and texts are most of what is written
    held.write.option("parquet.block.size", 8 << 20).parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)
