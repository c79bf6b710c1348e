"""What the operators share: reading tables, cutting lineage, and keeping extra columns out of the way."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []


#: Rows that go to a Python worker at once, where the session sets no number itself: texts can be long, and two batches are in flight a task.
BATCH_ROWS = 1000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    if spark.conf.get(_BATCH_KEY, None) is None:
        spark.conf.set(_BATCH_KEY, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only on a local master, as in tests, a temporary one takes its place where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="millrace-"))
        at = _own_dir[0]
    return at.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: it cuts lineage, and lost executors take nothing with them."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.materialized_at = at
    return out


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows. ``createDataFrame`` of a list goes through Python workers of its own, which executors then keep beside the others."""
    return spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in schema.split(", "))])


def _file_system(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def delete(spark: SparkSession, at: str) -> None:
    with contextlib.suppress(Exception):
        fs, path = _file_system(spark, at)
        fs.delete(path, True)


def forget(df: DataFrame) -> None:
    """Deletes what ``materialize`` wrote for ``df``, once nothing reads it any more. What results still read stays in the shared folder."""
    delete(df.sparkSession, df.materialized_at)


def write_small(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """A small file in a shared folder, whole or not at all."""
    fs, path = _file_system(spark, f"{folder}/{name}")
    draft = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/.{name}.draft")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(draft, path):
        raise OSError(f"{path} could not be written")


def read_small(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(name, text) of the small files in a folder, by name."""
    fs, path = _file_system(spark, folder)
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if not name.startswith("."):
            stream = fs.open(status.getPath())
            found.append((name, bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()))
            stream.close()
    return sorted(found)


def quantile_ranges(df: DataFrame, name: str, ranges: int) -> list[int]:
    """Where ranges of about equal rows begin (at most ``ranges``, of distinct values): few numbers, whatever the size or the gaps of ids."""
    qs = [k / ranges for k in range(ranges)]
    found = df.agg(F.percentile_approx(name, qs, 20 * ranges)).first()[0] or []
    return sorted(set(found))


def range_of(c: Column, starts: list[int]) -> Column:
    """The number of the range that a value is in; values below all ranges are in the first."""
    held = F.array(*[F.lit(x).cast("long") for x in starts[1:]]) if len(starts) > 1 else F.array().cast("array<bigint>")
    return F.size(F.filter(held, lambda x: x <= c)).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_rows(df: DataFrame, **columns) -> DataFrame:
    """``row``, a struct of all columns, beside the columns that an operator needs: whatever else a table has, its names can't clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def unwrapped(df: DataFrame, names: list[str], **changed) -> DataFrame:
    """The columns of ``row`` again, some of them changed."""
    return df.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in names])


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns: others, whatever their names, can't clash with the operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])
