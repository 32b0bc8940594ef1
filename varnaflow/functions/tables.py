"""Table functions for SQL: one row to many, and a table, part by part, to another.

``register`` makes them known to a session::

    SELECT doc_id, n, chunk FROM documents, LATERAL text_chunks(text, 125)
    SELECT * FROM patience(TABLE(curve) PARTITION BY model ORDER BY (epoch), 'loss', 3)
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


@udtf(returnType="n int, chunk string")
class TextChunks:
    """(n, chunk): the words of a text in chunks of at most ``most`` characters; a longer word is cut."""

    def eval(self, text: str | None, most: int) -> Iterator[tuple[int, str]]:
        text = text or ""
        if len(text) <= most:
            yield 0, text
            return
        n, now = 0, ""
        for word in text.split():
            longer = f"{now} {word}" if now else word
            if len(longer) <= most:
                now = longer
                continue
            whole = [now] * bool(now)
            whole, now = (whole, word) if len(word) <= most else (whole + [word[i : i + most] for i in range(0, len(word), most)], "")
            for chunk in whole:
                yield n, chunk
                n += 1
        if now:
            yield n, now


@udtf
class Patience:
    """The rows of a part with ``best`` so far, rows ``waited`` since it came, and whether a run would have ``stopped`` before.

    The part's state is three numbers, however many rows it has.
    """

    def __init__(self, analyzed: AnalyzeResult | None = None) -> None:
        self.best: float | None = None
        self.waited, self.stopped = 0, False

    @staticmethod
    def analyze(table: AnalyzeArgument, value: AnalyzeArgument, patience: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("the first argument is a table")
        if value.value not in table.dataType.names:
            raise ValueError(f"the table has no column {value.value}")
        schema = T.StructType(list(table.dataType.fields))
        for name, kind in (("best", T.DoubleType()), ("waited", T.LongType()), ("stopped", T.BooleanType())):
            schema = schema.add(name, kind)
        return AnalyzeResult(schema=schema)

    def eval(self, row: Row, value: str, patience: int) -> Iterator[tuple]:
        stopped = self.stopped
        found = row[value]
        if found is not None and (self.best is None or found < self.best):
            self.best, self.waited = float(found), 0
        else:
            self.waited += 1
        self.stopped = stopped or self.waited > patience
        yield (*row, self.best, self.waited, stopped)


@udtf
class Variations:
    """(key columns, n, sentence): every row's text with words replaced from its clusters, ``most`` times.

    Takes a table of (key..., text, clusters map<string, array<string>>); all columns
    but the last two are the key.  Choices are a hash of (n, place, word).
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, most: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable or len(table.dataType.fields) < 3:
            raise ValueError("the first argument is a table of a key, a text and its clusters")
        schema = T.StructType(list(table.dataType.fields)[:-2])
        return AnalyzeResult(schema=schema.add("n", T.IntegerType()).add("sentence", T.StringType()))

    def eval(self, row: Row, most: int) -> Iterator[tuple]:
        import zlib

        *key, text, clusters = row
        for n in range(1, most + 1):
            out = []
            for i, word in enumerate((text or "").split()):
                choice = (clusters or {}).get(word.lower())
                out.append(choice[zlib.crc32(f"{n}:{i}:{word}".encode()) % len(choice)] if choice else word)
            yield (*key, n, " ".join(out))


FUNCTIONS = {"text_chunks": TextChunks, "patience": Patience, "variations": Variations}


def register(spark: SparkSession) -> SparkSession:
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
    return spark
