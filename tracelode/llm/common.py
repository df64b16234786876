"""What several operators of this subpackage share: lineage cuts, Arrow batch limits, tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..plans.lineage import cut as cut
from ..plans.lineage import python_path
from ..plans.lineage import shared_dir as shared_dir
from ..plans.spread import fresh as fresh
from ..plans.spread import hot_keys as hot_keys
from ..plans.spread import split_join as split_join

#: Rows in one Arrow batch sent to Python; texts may be long, so far fewer than the default.
ARROW_ROWS = 1024


def cut_table(df: DataFrame) -> tuple[DataFrame, str]:
    """Like cut(), for larger data: written as Parquet, which is compressed and read by column. Also its path, for drop_table()."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at), at


def drop_table(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def arrow_limits(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the Arrow batches of this session, so that a batch of long texts fits in memory.

    Python workers also get this package's place, where their path lacks it.
    """
    python_path(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else: lower() also changes letters outside ASCII."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def quoted(name: str) -> str:
    """A column's name as Spark's parser wants it, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def map_whole_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[list[pa.Array]]], added: list[StructField]) -> DataFrame:
    """df with further columns: run yields all columns of its batches, by place, so that columns may have any names."""
    names = [f"c{k}" for k in range(len(df.columns) + len(added))]

    def batches(own: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in run(own):
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = StructType([StructField(n, f.dataType) for n, f in zip(names, [*df.schema.fields, *added], strict=True)])
    return df.toDF(*names[: len(df.columns)]).mapInArrow(batches, schema).toDF(*df.columns, *(f.name for f in added))


def small(df: DataFrame, rows: int) -> bool:
    """Whether df has at most that many rows; reads no more than one beyond."""
    return df.limit(rows + 1).count() <= rows
