"""Session helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def session(name: str = "lodestone", **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC times; ``conf`` in addition, dots written as double underscores."""
    b = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def ship_code(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each Spark context, so that they need no copy of their own."""
    sc = spark.sparkContext
    if getattr(sc, "_lodestone_code", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lodestone-code-"), "lodestone_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(path)
    sc._lodestone_code = True


def settle(df):
    """``df`` written to the checkpoint folder that all executors share, its lineage cut there.

    The folder is ``spark.checkpoint.dir``; where none is set, local mode uses one of its own and a cluster raises.
    """
    _shared(df.sparkSession)
    return df.checkpoint()


def _shared(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="lodestone-checkpoint-"))
    return sc.getCheckpointDir()


def shelve(df, by: str) -> str:
    """``df`` written to the shared folder, a folder for each value of ``by``; the URI of the whole, for ``shelf``."""
    spark = df.sparkSession
    uri = f"{_shared(spark).rstrip('/')}/shelf-{uuid.uuid4().hex}"
    df.write.partitionBy(by).parquet(uri)
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def shelf(uri: str, by: str, value: int):
    """On an executor: the Arrow table of one value's folder of ``shelve``, or None where there is none."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    system, path = (fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")) if re.match("file:", uri) else fs.FileSystem.from_uri(uri)
    path = f"{path}/{by}={value}"
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return None
    return ds.dataset(path, filesystem=system, format="parquet").to_table()
