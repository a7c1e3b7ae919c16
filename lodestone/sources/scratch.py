"""Cutting a plan's lineage: rows written to the folder that all executors share, and read back."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_place(spark: SparkSession, name: str) -> str:
    """A new name in the shared folder, deleted when the driver ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir isn't set: intermediate tables need a folder that all executors share")
        folder = Path(tempfile.mkdtemp(prefix="lodestone-")).as_uri()  # tests and single machines
        spark.conf.set("spark.checkpoint.dir", folder)
    place = f"{folder}/lodestone/{name}-{uuid.uuid4().hex}"
    _written[place] = spark
    return place


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    spark = df.sparkSession
    place = shared_place(spark, name)
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def release() -> None:
    """Delete all scratch folders of this driver; results that still read them must be consumed before."""
    while _written:
        place, spark = _written.popitem()
        if spark.sparkContext._jsc is not None:
            with contextlib.suppress(Exception):  # the context may be gone; a folder left over does no harm
                target = spark._jvm.org.apache.hadoop.fs.Path(place)
                target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


atexit.register(release)
