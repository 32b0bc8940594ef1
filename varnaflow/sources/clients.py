"""Sources behind a service: models, labellers, generators and paged comments.

A client is a plain callable that the caller gives; nothing here opens a
connection by itself.  Results keep the id of their input row.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import numbered_line, roman_devanagari_pair


class ServiceError(Exception):
    """An answer of the service that isn't a result."""

    def __init__(self, status: int, reason: str = "") -> None:
        super().__init__(f"{status} {reason}")
        self.status, self.reason = status, reason


def call_with_retry(call: Callable[[], object], retries: int = 3, wait: Callable[[float], None] = time.sleep) -> object:
    """Try again after 1, 2, 4 ... seconds on 429, 500 and 503."""
    for attempt in range(retries + 1):
        try:
            return call()
        except ServiceError as e:
            if e.status not in (429, 500, 503) or attempt == retries:
                raise
            wait(2.0**attempt)
    raise AssertionError


def infer(frame: DataFrame, column: str, model: Callable[[list[str]], list[str]], batch: int = 32, output: str = "output") -> DataFrame:
    """``frame`` with the model's output; a row whose batch fails has an empty string."""
    schema = T.StructType([*frame.schema.fields, T.StructField(output, T.StringType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out: list[str] = []
            values = part[column].fillna("").tolist()
            for i in range(0, len(values), batch):
                try:
                    got = list(model(values[i : i + batch]))
                except Exception:  # noqa: BLE001  the contract: a failed call leaves blanks
                    got = []
                out += [*got, *[""] * len(values[i : i + batch])][: len(values[i : i + batch])]
            yield part.assign(**{output: out})

    return frame.mapInPandas(run, schema)


def label_batches(frame: DataFrame, answer: Callable[[list[str]], str], size: int = 10, start: int = 0) -> DataFrame:
    """(id, romanized, devanagari) from numbered answers to batches of ``size`` rows of (n, value).

    ``n`` counts from 1; an answer with fewer lines labels only the first rows of its batch.
    """
    batches = frame.groupBy(F.floor((F.col("n") - 1) / size).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("rows"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"rows": part["rows"], "answer": [answer([r["value"] for r in rows]) for rows in part["rows"]]})

    asked = batches.select("rows").mapInPandas(run, "rows array<struct<n:bigint,value:string>>, answer string")
    lines = F.filter(F.transform(F.split("answer", "\n"), numbered_line), lambda x: x.isNotNull())
    pairs = F.arrays_zip(F.slice("rows", F.lit(1), F.least(F.size("rows"), F.size(lines))).alias("r"), F.slice(lines, F.lit(1), F.least(F.size("rows"), F.size(lines))).alias("d"))
    return asked.select(F.explode(pairs).alias("p")).select((F.col("p.r.n") + start).alias("id"), F.col("p.r.value").alias("romanized"), F.col("p.d").alias("devanagari"))


def generate_pairs(spark: SparkSession, ask: Callable[[int], str], total: int = 3000, size: int = 15) -> DataFrame:
    """(romanized, devanagari): parsed answers of as many calls as ``total`` needs, ``total`` rows at most."""
    calls = spark.range(-(-total // size))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"id": part["id"], "answer": [ask(size) for _ in part["id"]]})

    answers = calls.mapInPandas(run, "id bigint, answer string").select("id", F.posexplode(F.split("answer", "\n")).alias("n", "line"))
    pairs = answers.withColumn("pair", roman_devanagari_pair(F.col("line"))).where("pair is not null")
    return pairs.orderBy("id", "n").limit(total).select("pair.*")


class CommentSource(DataSource):
    """Paged comments of videos.

    Options: ``videos`` (comma-separated ids), ``client`` as ``module:function``; the
    function is called with (video, page token, key number) and returns
    (comments, next token).  On 403 for quota the next of ``keys`` (a count) is used;
    any other refusal, or the last key's, fails the read, unless ``partial`` is
    ``true``: then a video keeps the comments that came before it.
    """

    @classmethod
    def name(cls) -> str:
        return "video_comments"

    def schema(self) -> str:
        return "video string, n int, comment string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return CommentReader(self.options)


class CommentReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.videos = [v for v in options.get("videos", "").split(",") if v]
        self.client, self.keys = options["client"], int(options.get("keys", "1"))
        self.partial = options.get("partial", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(v) for v in self.videos]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import importlib

        module, _, name = self.client.partition(":")
        fetch = getattr(importlib.import_module(module), name)
        token, key, n = None, 0, 0
        while True:
            try:
                comments, token = call_with_retry(lambda token=token, key=key: fetch(partition.value, token, key))
            except ServiceError as e:
                if e.status == 403 and "quota" in e.reason and key + 1 < self.keys:
                    key += 1
                    continue
                if not self.partial:
                    raise
                return
            for c in comments:
                yield partition.value, n, c
                n += 1
            if not token:
                return


def channel_videos(listing: Callable[[str], list[str]], channels: list[str], spark: SparkSession) -> DataFrame:
    """(channel, video) by a caller's listing function, called once for each channel on the executors."""
    named = spark.createDataFrame([(c,) for c in channels], "channel string").repartition(max(1, min(len(channels), spark.sparkContext.defaultParallelism)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for channel in part["channel"]:
                yield pd.DataFrame({"channel": channel, "video": list(listing(channel))}, columns=["channel", "video"])

    return named.mapInPandas(run, "channel string, video string")
