"""Shared scratch tables: how a job cuts its lineage so that it survives a lost executor.

A table goes to the folder that the cluster names in ``spark.checkpoint.dir``. Only where that
setting is missing and the master is local (tests, a laptop) a local folder is made and set.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import weakref
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The blocks of work that are open in this thread or task, outermost first.
_OPEN: ContextVar[tuple[scratch, ...]] = ContextVar("open_blocks", default=())
#: Where a table that was written lies, as long as the table itself is held.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: What no block deletes: results' tables, which go with the session.
_LEFT: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for scratch tables, from the session's settings."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "leadmill-scratch")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialise(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the table read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/leadmill/{uuid.uuid4().hex}/{name}"
    schema = df.schema
    df.write.option("compression", compression).parquet(path)
    table = spark.read.schema(schema).parquet(path)
    _PATHS[table] = path
    _owned(spark, path)
    return table


def _owned(spark: SparkSession, path: str) -> None:
    """A path belongs to the innermost open block, else to the session."""
    if _OPEN.get():
        _OPEN.get()[-1].paths.append(path)
    else:
        _LEFT[path] = spark


@atexit.register
def clear() -> None:
    """Deletes the tables of finished results; runs by itself when Python ends, and may be called once all are read."""
    for path, spark in list(_LEFT.items()):
        _LEFT.pop(path)
        if spark.sparkContext._jsc is not None:  # a stopped session's tables are left to the cluster's folder
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, in whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class scratch:
    """A block of work: tables written inside it are deleted at its end, but for those given to ``keep``.

    A kept table belongs to the block around this one, if there is one. Only tables whose readers
    have all been written by then may be left to deletion.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, [], set()

    def __enter__(self) -> scratch:
        self.token = _OPEN.set((*_OPEN.get(), self))
        return self

    def keep(self, table: DataFrame) -> DataFrame:
        self.kept.add(_PATHS[table])
        return table

    def drop(self, table: DataFrame) -> None:
        """Deletes a table before the end of the block, as all its readers have been written."""
        path = _PATHS[table]
        self.paths.remove(path)
        remove(self.spark, path)

    def __exit__(self, *failure) -> None:
        _OPEN.reset(self.token)
        for path in self.paths:
            if path in self.kept:
                _owned(self.spark, path)
            else:
                remove(self.spark, path)


def _bytes(df: DataFrame):
    """Bytes of a row's values; 8 for one of fixed width."""
    from pyspark.sql import functions as F

    total = F.lit(0)
    for field in df.schema.fields:
        kind, column = field.dataType.typeName(), F.col(f"`{field.name}`")
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(column), F.lit(0))
        elif kind in ("array", "map", "struct"):
            total = total + F.coalesce(F.octet_length(F.to_json(column)), F.lit(0))
        else:
            total = total + 8
    return F.coalesce(F.sum(total.cast("long") + 16), F.lit(0))


def broadcast_if_small(df: DataFrame, most: int = 32 << 20) -> DataFrame:
    """``df`` with a broadcast hint if its values take at most ``most`` bytes; beyond that the plain frame."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.agg(_bytes(df)).first()[0] <= most else df
