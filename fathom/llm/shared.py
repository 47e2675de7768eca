"""Places and tables that every executor and the driver can see.

Intermediate tables are Parquet folders below the session's ``spark.checkpoint.dir``; reading
them back cuts the lineage, so a lost executor never makes an operator recompute its past.
"""

from __future__ import annotations

import contextlib
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def is_local(spark: SparkSession) -> bool:
    """Whether the driver is the only executor."""
    return re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is not None


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the session's shared folder.

    A local session without the setting (tests) gets a temporary folder of this machine; a
    session on a cluster without it is refused, since executors could not see such a folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="fathom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again; :func:`discard` deletes it."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of :func:`stored` that nothing reads any more, through Hadoop."""
    for table in tables:
        path = getattr(table, "_stored", None)
        if path:
            spark = table.sparkSession
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
            table._stored = None


def fresh(columns: list[str], stem: str) -> str:
    """A column name that is not among ``columns``."""
    taken, name, number = {c.lower() for c in columns}, f"_{stem}", 0
    while name.lower() in taken:
        number += 1
        name = f"_{stem}_{number}"
    return name


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps.

    Executors delete them only once the driver's JVM has collected their handles, which a driver
    with little to do may not do for half an hour. Steps that end in a stored table need none.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def filesystem(uri: str):
    """``(pyarrow filesystem, path)`` for a URI or a plain path; works on executors."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def replaced(uri: str):
    """Open ``uri`` for writing under a name of this attempt; move it into place at the end.

    A retried or doubled task therefore leaves exactly one whole file under the final name.
    """
    system, path = filesystem(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(own) as out:
        yield out
    system.move(own, path)
