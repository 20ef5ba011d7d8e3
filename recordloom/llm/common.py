"""Shared helpers of the training-data operators: table access, Arrow passes, the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


ROWS = 1000  # rows that a Python pass holds as objects at once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str):
    """A column whose name may hold dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that the scan is pruned; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without columns of these names, which an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.select(*[col(c) for c in df.columns if c.lower() not in taken])


def binary(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an array of texts; a null is empty."""
    data = text.fill_null("").cast(pa.binary())
    if not len(data):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    whole = np.frombuffer(data.buffers()[2], np.uint8) if data.buffers()[2] is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def parts_of(text: pa.Array, size: int) -> Iterator[pa.Array]:
    """Runs of texts of about `size` bytes; a longer text is one."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(text):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield text.slice(at, stop - at)
        at = stop


def annotate(df: DataFrame, inputs: list[str], fn: Callable[..., list], added: str, raw: bool = False) -> DataFrame:
    """df with the columns of the DDL schema `added`, which fn makes from lists of the inputs' values (raw: from Arrow arrays).

    A column of df that has the name of an added column is replaced. One narrow pass: no shuffle.
    """
    new = T.StructType.fromDDL(added)
    names = [f.name for f in new]
    base = without(df, names)
    source = base.select("*", *[F.col(c).alias(f"__in{k}") for k, c in enumerate(inputs)]) if not (set(names) & set(inputs)) else df.select(*[col(c) for c in base.columns], *[F.col(c).alias(f"__in{k}") for k, c in enumerate(inputs)])
    width = len(base.columns)
    schema = T.StructType([*base.schema, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = list(to_arrow_schema(new))
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, max(1, whole.num_rows), ROWS)):
            out = fn(*[c if raw else c.to_pylist() for c in (batch.column(width + k) for k in range(len(inputs)))])
            made = [x if isinstance(x, pa.Array) else pa.array(x, kinds[k].type) for k, x in enumerate(out)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *made], names=[f.name for f in schema])

    return source.mapInArrow(run, schema)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the folder that driver and executors share."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it's unset, a local folder, but only if driver and executors are one process."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/recordloom-checkpoints"
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(root)
    return root


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """Has the folder deleted when the application ends."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()
