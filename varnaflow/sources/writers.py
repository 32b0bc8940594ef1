"""Sinks.

Exports keep Spark's partitioned files.  ``write_one_file`` makes one ordered file of
any size: all tasks write to it at once, each at the place where its rows belong.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scans import kept

#: Bytes that a task gathers before it writes them.
_TOGETHER = 4 << 20


def _mounted(path: str) -> str:
    """The path of a file on a mounted file system."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"one file is written in place, which {parts.scheme}: can't do; write parts instead")
    return unquote(parts.path) if parts.scheme else path


def write_one_file(frame: DataFrame, path: str, value: Column, order: list[str | Column], header: str = "", separator: str = "\n", footer: str | None = None, bom: bool = False) -> None:
    """One file of UTF-8: mark, header, the rows in ascending order, each ended by ``separator``; with a footer that stands for the last separator.

    ``path`` lies on a file system that all executors mount.  Rows are dealt out by
    ranges of the order and stored; the bytes of each range, one number a range, give
    the place of the next.  Every task then writes its rows at their place in a file
    beside ``path``, which takes its name only when all are done: a task that fails
    and runs again writes the same bytes at the same place, and a job that fails
    leaves ``path`` as it was.  Null values are empty.
    """
    target = _mounted(path)
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = frame.select(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(by)]).alias("o"), F.coalesce(value.cast("string"), F.lit("")).alias("v"), F.monotonically_increasing_id().alias("tie"))
    ranges = kept(rows.repartitionByRange("o", "tie").withColumn("part", F.spark_partition_id()), "export")
    gap, start = len(separator.encode()), (b"\xef\xbb\xbf" if bom else b"") + header.encode()
    sizes = ranges.groupBy("part").agg(F.sum(F.octet_length("v") + gap).alias("bytes"))
    before = F.coalesce(F.sum("bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = kept(sizes.select(F.col("part").alias("p"), before.alias("at"), "bytes"), "places")
    total = places.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    draft = f"{target}.draft"
    os.makedirs(os.path.dirname(target), exist_ok=True)
    with open(draft, "wb") as f:
        f.write(start)
        f.truncate(len(start) + total)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = os.open(draft, os.O_WRONLY)
        part, at, held, size = None, 0, [], 0

        def flush() -> None:
            nonlocal at, held, size
            data = b"".join(held)
            os.pwrite(file, data, len(start) + at)
            at, held, size = at + len(data), [], 0

        for batch in batches:
            for p, begin, v in zip(*(batch.column(c).to_pylist() for c in ("part", "at", "v")), strict=True):
                if p != part:
                    flush()
                    part, at = p, begin
                held.append(f"{v}{separator}".encode("utf-8", "surrogatepass"))
                size += len(held[-1])
                if size > _TOGETHER:
                    flush()
        flush()
        os.fsync(file)
        os.close(file)
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int32())], ["done"])

    placed = ranges.join(places, F.col("part") == F.col("p")).repartition("part").sortWithinPartitions("part", "o", "tie").select("part", "at", "v")
    try:
        placed.mapInArrow(write, "done int").count()
        if footer is not None:
            with open(draft, "r+b") as f:
                f.truncate(len(start) + max(0, total - gap))
                f.seek(0, os.SEEK_END)
                f.write(footer.encode())
    except BaseException:
        os.remove(draft)
        raise
    os.replace(draft, target)


def csv_line(*columns: str, keep_empty: bool = False) -> Column:
    """A row as a line of CSV: values with commas, quotes or line breaks are quoted (and U+FFFF, which would end a reading).

    ``keep_empty`` quotes empty values too, so that they are told from nulls.
    """

    def field(c: str) -> Column:
        v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        quoted = v.rlike('[",\\r\\n\\uffff]')
        quoted = quoted | (F.col(c).cast("string") == "") if keep_empty else quoted
        return F.when(quoted, F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

    return F.concat_ws(",", *[field(c) for c in columns])


def pvd_json(groups: DataFrame, path: str, order: list[str | Column], code: str = "code", base: str = "base_word", variants: str = "variants") -> None:
    """One JSON object of all entries, {code: {base_word, variants}}, in the given order."""
    entry = F.to_json(F.create_map(F.col(code), F.struct(F.col(base).alias("base_word"), F.col(variants).alias("variants"))))
    inner = F.expr("substring(entry, 2, length(entry) - 2)")
    write_one_file(groups.withColumn("entry", entry), path, inner, order, header="{", separator=", ", footer="}")


def write_lines(frame: DataFrame, path: str, column: str = "value") -> None:
    """One row a line."""
    frame.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_csv(frame: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header, values as they are."""
    writer = frame.write.mode(mode).option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_csv_file(frame: DataFrame, path: str, order: list[str | Column], bom: bool = True, keep_empty: bool = False) -> None:
    """One CSV file with its header, and a byte-order mark for programs that need it, once."""
    write_one_file(frame, path, csv_line(*frame.columns, keep_empty=keep_empty), order, header=",".join(frame.columns) + "\n", bom=bom)


def append_rows(frame: DataFrame, path: str) -> None:
    """Append as Parquet; made on first use."""
    frame.write.mode("append").parquet(path)


def pvd_document(groups: DataFrame, code: str = "code", base: str = "base_word", variants: str = "variants") -> DataFrame:
    """One row for each entry, as a line of JSON: {code: {base_word, variants}}, in code order."""
    entry = F.create_map(F.col(code), F.struct(F.col(base).alias("base_word"), F.col(variants).alias("variants")))
    return groups.orderBy(code).select(F.to_json(entry).alias("value"))


def write_by_key(frame: DataFrame, path: str, *keys: str) -> None:
    """A folder for each key; rows of a key are spread by AQE, not gathered in one task."""
    frame.hint("rebalance", *keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


def merge_texts(spark: SparkSession, inputs: list[str], path: str) -> None:
    """All lines of the inputs in one text folder."""
    spark.read.text(inputs).write.mode("overwrite").text(path)


def corpus_text(frame: DataFrame, path: str, column: str = "value") -> None:
    """Lines that have Devanagari left, as one corpus."""
    from ..functions.text import keep_devanagari

    out = frame.select(keep_devanagari(F.col(column)).alias("value")).where("value <> ''")
    out.write.mode("overwrite").text(path)
