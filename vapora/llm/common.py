"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into Python objects at once, and of one Arrow batch sent to a Python worker.
SLICE, BATCH = 2 << 20, 4 << 20
#: Java regex of the ASCII white space that separates words.
SPACE = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH bytes instead of Spark's 64 MB, unless the session asks for smaller ones."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, "67108864").rstrip("b")) > BATCH:
        spark.conf.set(name, str(BATCH))


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the named columns alone, so that other columns can't clash with working names."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c) for c in more))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where all run in one process a temporary one will do."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="vapora-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: lineage ends there, and a lost executor can't change it.

    The folder is deleted when the application ends, or by discard().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vapora/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.vapora_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialize() wrote; nothing may read it any more."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(df.vapora_path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bucketed(df: DataFrame, key: str, name: str, to: DataFrame | None = None, last: bool = True) -> DataFrame:
    """df written once in buckets of a column, so that grouping by it later shuffles nothing.

    Rows may be added in further calls, to what the call before gave, which was not the last; the result has all of them.
    """
    spark = df.sparkSession
    if to is None:
        table = f"vapora_{uuid.uuid4().hex}"
        path = f"{shared_dir(spark)}/vapora/{name}-{table}"
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    else:
        # dealt as the buckets are, each task adds one file
        table, path, df = to.vapora_table, to.vapora_path, df.repartition(partitions(spark), key)
    df.write.format("parquet").mode("append").bucketBy(partitions(spark), key).option("path", path).option("compression", "zstd").saveAsTable(table)
    out = spark.table(table)
    out.vapora_table, out.vapora_path = table, path
    if last:
        spark.sql(f"DROP TABLE {table}")  # the name alone: the files are external
    return out


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the column's texts take about `size` bytes each; a longer text is a slice by itself."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
            yield batch.slice(at, to - at)
            at = to


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once, wherever f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salt(n: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def spread(df: DataFrame, n: int | Column, name: str = "salt") -> DataFrame:
    """Each row once for every salt below n."""
    n = F.lit(n) if isinstance(n, int) else n
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))


#: Least and most bits of a filter, as powers of two: 128 kB to 64 MB.
FILTER_LEAST, FILTER_MOST = 20, 29
#: Bits of one row of a filter, as a power of two: 4 kB.
FILTER_ROW = 15


class Filter:
    """A bit for each number of a table, some 16 bits a number; more numbers than FILTER_MOST serves only let more rows pass.

    It is a table of rows of 4 kB, 64 MB at most, and so is broadcast; it never reaches the driver's Python.
    """

    def __init__(self, numbers: DataFrame, column: str):
        self.bits = min(FILTER_MOST, max(FILTER_LEAST, (16 * numbers.count()).bit_length()))
        row, bit = self._place(F.col(column))
        self.rows = numbers.select(row.alias("filter_row"), bit.alias("bit")).groupBy("filter_row").agg(F.bitmap_construct_agg("bit").alias("filter_bits"))

    def _place(self, number: Column) -> tuple[Column, Column]:
        low = number.bitwiseAND(F.lit((1 << self.bits) - 1))
        return F.shiftright(low, FILTER_ROW), low.bitwiseAND(F.lit((1 << FILTER_ROW) - 1))

    def mark(self, df: DataFrame, number: Column, out: str) -> DataFrame:
        """df and whether its number may be in the table."""
        row, bit = self._place(number)
        df = df.withColumn("filter_row", row).join(F.broadcast(self.rows), "filter_row", "left")
        byte = F.conv(F.hex(F.substring("filter_bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        seen = F.getbit(byte.cast("long"), bit.bitwiseAND(F.lit(7)).cast("int")) == 1
        return df.withColumn(out, F.coalesce(seen, F.lit(False))).drop("filter_row", "filter_bits")
