"""Plumbing shared by the corpus operators: scratch tables, table reading, batch limits."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DataType, NumericType, StringType

#: Bytes and rows that one Arrow batch may hold on its way to a Python worker.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 2000


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Where it is unset a private folder serves local masters; a cluster without the setting is an error,
    because a machine-local folder would not be seen by the other executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    global _own_root
    if _own_root is None:
        _own_root = tempfile.TemporaryDirectory(prefix="hostweave-", ignore_cleanup_errors=True)
    return "file://" + _own_root.name


_own_root: tempfile.TemporaryDirectory | None = None


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/hostweave/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str = "cut", codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and return the written table, which ends its lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def discard(table: DataFrame | None) -> None:
    """Delete a table that ``cut`` wrote and nothing reads any more."""
    path = getattr(table, "_scratch", None)
    if path:
        spark = table.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        with contextlib.suppress(Exception):  # what can't be deleted only costs space
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, since one row may hold a text of many megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: What frees the caches that a worker process keeps between tasks; whose tasks it last ran.
kept: list[Callable[[], None]] = []
_user: str | None = None


def begin(user: str) -> None:
    """Call as a task begins in a Python worker: it keeps caches between tasks of one user only.

    A worker serves one operator after another. What each leaves in caches and in the pools of allocators would
    add up, so at a change of users caches are freed and unused memory is given back.
    """
    global _user
    if user == _user:
        return
    _user = user
    for free in kept:
        free()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_fold(doc_id, folds: int):
    """crc32 of the decimal text of an id, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Settings of the session for jobs within the block; what was set before is set again after it."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def batches(spark: SparkSession, rows: int):
    """Larger Arrow batches for jobs within the block, whose rows are a few numbers each."""
    return settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)})


#: Rows of one key up to which it is never split.
HOT_LEAST = 500


def _no_key(kind: DataType):
    """Some value of a key's type, or None where it is not known how to write one."""
    if isinstance(kind, NumericType):
        return F.lit(0).cast(kind)
    return {StringType: F.lit(""), BinaryType: F.lit(bytearray()), BooleanType: F.lit(False)}.get(type(kind))


def salted_join(rows: DataFrame, table: DataFrame, on: list[str], total: int, spread: list[str], count: str = "n") -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each key and in ``count`` how many of ``rows`` have it.

    A key with over a quarter of a partition's even share of all ``total`` rows is dealt out by a hash of the
    columns ``spread``. At most four such keys a partition can exist, which bounds the list that is broadcast. The
    list always has one key more, undealt, so that the plan is the same whether there are hot keys or not.
    """
    spark = rows.sparkSession
    most = max(HOT_LEAST, total // (4 * shuffle_width(spark)))
    parts = F.ceil(F.col(count) / most).cast("int")
    hot = table.filter(F.col(count) > most).select(*on, parts.alias("_parts"))
    none = [_no_key(table.schema[c].dataType) for c in on]
    if all(v is not None for v in none):
        one = spark.range(1).select(*(v.alias(c) for v, c in zip(none, on, strict=True)), F.lit(1).alias("_parts"))
        hot = hot.unionAll(one).groupBy(*on).agg(F.max("_parts").alias("_parts"))
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).drop(count)
    return dealt.join(copies, [*on, "_salt"]).drop("_salt")
