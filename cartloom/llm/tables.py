"""Reading the given tables, and what several operators share."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

import cartloom

#: Words are runs of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Rows are learned from unless their ids' checksum is a multiple of this.
FOLDS = 5


BATCH_ROWS = 500
#: Bytes of rows that go to a Python worker, or come back, at a time; Spark's own limit is 64 MB in buffers of up to twice that.
BATCH_BYTES = 4 << 20

# What this Python worker holds from one task to the next.
_held: dict[str, object] = {}


def held(name: str, make: Callable[[], object]) -> object:
    """The model or encoder ``name``, made once a Python worker, which holds only the last one."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def let_go() -> None:
    """For tasks without a model: what earlier tasks of this worker left isn't held any longer."""
    _held.clear()


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session hold at most ``BATCH_BYTES``: texts may be long, and their batches are copied several times."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def reachable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver has it, if they have that folder too."""
    environment, home = spark.sparkContext.environment, str(Path(cartloom.__file__).resolve().parent.parent)
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, home])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """The fold that no model learns from: crc32 of the id as text, modulo 5, is 0. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(True))


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``BATCH_ROWS``, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


def map_texts(docs: DataFrame, make: Callable[[], Callable[[list], Iterable[tuple]]], columns: str,
              key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, and ``columns`` (DDL) computed from the text.

    ``make`` is called once a task; what it returns maps a list of texts to one
    tuple a text. All other columns of ``docs`` are left out.
    """
    small_batches(docs.sparkSession)
    made = T.StructType.fromDDL(columns)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *made.fields])
    names, kinds = schema.names, to_arrow_schema(made).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_of = make()
        for batch in small(batches):
            rows = list(rows_of(batch.column(1).to_pylist()))
            values = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(v, t) for v, t in zip(values, kinds, strict=True))], names=names)

    return docs.select(F.col(key), F.col(text).cast("string").alias("_text_")).mapInArrow(run, schema)


def whole_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each row as one struct ``row`` next to its text, so that a decision can travel with it."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text).cast("string").alias("text"))
