"""What the operators share: the shared folder, stored tables and id columns."""

from __future__ import annotations

import ctypes
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path, shared_dir  # noqa: F401

#: Words of the contracts that split on ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Cuts the lineage: what follows never recomputes ``df``, and survives lost
    executors because the files are in the shared store.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): only these two columns, whatever else ``docs`` has; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """Names like ``wanted`` that no column has, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        found = next(n for n in (name, *(f"{name}_{k}" for k in range(len(taken) + 1))) if n.lower() not in taken)
        taken.add(found.lower())
        out.append(found)
    return out


def row_key() -> Column:
    """Tells rows apart that repeat a doc_id with another text."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, without decoding; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def batches_by_bytes(batch: pa.RecordBatch, column: str, most: int = 8 << 20):
    """Slices of a batch with about ``most`` bytes in ``column`` each, one row at least."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)
    release()


@lru_cache(maxsize=1)
def _trim():  # noqa: ANN202
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda _: None


def release() -> None:
    """Give memory that this worker has freed back, so that it doesn't stay the size of its largest batch."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
