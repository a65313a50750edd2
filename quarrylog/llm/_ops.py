"""Shared plumbing of the operators: column selection, Arrow maps and places for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pick(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named columns, under work names; everything else in the table is left behind."""
    return df.select(*(df[c].alias(k) if isinstance(c, str) else c.alias(k) for k, c in columns.items()))


def give_back() -> None:
    """Returns freed memory to the system: a worker outlives its task and would else keep the most it ever held."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        return


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow where fn yields dicts of columns for each batch."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                for columns in fn(batch):
                    arrays = [pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in target]
                    yield pa.RecordBatch.from_arrays(arrays, schema=target)
                give_back()

    return df.mapInArrow(run, schema)


def spread(table: DataFrame) -> DataFrame:
    """A table as read from files; one of fewer splits than the cluster has cores is dealt out among them."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def shared_dir(spark: SparkSession) -> str:
    """A new path below the folder the cluster shares for checkpoints (spark.checkpoint.dir).

    Where it is unset, a folder of this machine, which only local mode can share.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"{tempfile.gettempdir()}/quarrylog-checkpoints"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write the table to the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_mod(key: Column, divisor: int) -> Column:
    """crc32 of the key's text modulo the divisor; a null key gives null."""
    return F.crc32(key.cast("string")) % divisor
