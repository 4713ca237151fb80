"""Shared helpers: reading tables, staged tables in the shared folder, word classes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from the session's setting; one of our own only on one machine where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            found = held.get()
        elif not sc.master.startswith("local") or sc.master.startswith("local-"):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        else:
            found = "file://" + tempfile.mkdtemp(prefix="tessera-")
            sc.setCheckpointDir(found)
    return found.rstrip("/")


#: With it a query's shuffles are deleted as soon as it has ended, not when the driver's JVM happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{label}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df.staged_at)
        _STAGED.remove(df.staged_at)


#: Rows of a table that is broadcast.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` to be broadcast if it has few rows, as it is otherwise. It is counted, so it should be a stored table of slim rows."""
    return F.broadcast(df) if df.count() <= most else df


_STAGED: list[str] = []


def drop_staged(spark: SparkSession) -> int:
    """Delete the tables that this process has staged; results that still read them must be written before. Returns their number."""
    gone = len(_STAGED)
    while _STAGED:
        _delete(spark, _STAGED.pop())
    return gone


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Items whose results are gathered in one array.
CHUNK = 256


def in_chunks(items: Column, start: Column, none: Column, step) -> Column:
    """The array that ``step(struct<at, out>, item)`` gathers in ``out`` over all items, ``at`` being carried along.

    Adding to an array copies it. So items are taken ``CHUNK`` at a time, each chunk's results being an array of its own, and these
    are joined once: a text with very many matches isn't a matter of their square.
    """
    chunks = F.transform(
        F.array(items),  # bound to a variable, so it is made once
        lambda x: F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / CHUNK).cast("int")), lambda k: F.slice(x, k * CHUNK + 1, F.lit(CHUNK))),
    )[0]
    nested = F.slice(F.array(none), F.lit(1), F.lit(0))

    def chunk_step(acc: Column, own: Column) -> Column:
        made = F.transform(
            F.array(F.aggregate(own, F.struct(acc["at"].alias("at"), none.alias("out")), step)),
            lambda m: F.struct(m["at"].alias("at"), F.concat(acc["out"], F.array(m["out"])).alias("out")),
        )
        return made[0]

    return F.aggregate(chunks, F.struct(start.alias("at"), nested.alias("out")), chunk_step, lambda acc: F.flatten(acc["out"]))
