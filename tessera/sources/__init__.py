"""Tables from folders of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_SCHEMAS: dict = {}


def folder(spark: SparkSession, path: str, kind: str = "parquet", **options) -> Callable[[str], DataFrame | None]:
    """name -> the table stored as <path>/<name>.<kind>, None if there is none; columns and filters are pushed into the scan.

    A table's schema is read again only when its file or folder has changed.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def table(name: str) -> DataFrame | None:
        at = f"{path}/{name}.{kind}"
        file = jvm.org.apache.hadoop.fs.Path(at)
        fs = file.getFileSystem(conf)
        if not fs.exists(file):
            return None
        status = fs.getFileStatus(file)
        mark = (at, status.getModificationTime(), status.getLen(), kind, repr(sorted(options.items())))
        reader = spark.read.format(kind).options(**options)
        if not status.getModificationTime():  # stores that keep no time for folders
            return reader.load(at)
        if mark not in _SCHEMAS:
            _SCHEMAS[mark] = reader.load(at).schema
        return reader.schema(_SCHEMAS[mark]).load(at)

    return table
