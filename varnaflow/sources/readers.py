"""Sources: text lines, CSV corpora, dictionaries and vocabularies.

Schemas are always given, never inferred.  Line order is carried in a column;
nothing depends on the order of partitions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_token, strip, text
from ..operators.scans import numbered, prefix_scan

PARALLEL = "romanized string, devanagari string"
LABELLED = "id bigint, romanized string, devanagari string"
PVD_JSON = "map<string, struct<base_word: string, variants: array<string>>>"


def spread(frame: DataFrame) -> DataFrame:
    """A table whose scan has fewer tasks than the cluster has cores, dealt out; others are left as they lie.

    A small table is often one file with one row group, which would be one task.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


def text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, value): stripped lines that aren't blank."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), strip(F.col("value")).alias("value"))
    return lines.where("value <> ''")


def _placed(spark: SparkSession, path: str | list[str], separator: str = "\n", exact: bool = False) -> DataFrame:
    """(file, block, at, value): records of text files with the offset of the split that they were read in, and their order there; without ``exact`` carriage returns end lines too."""
    reader = spark.read if separator == "\n" and not exact else spark.read.option("lineSep", separator)
    return reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def numbered_lines(spark: SparkSession, path: str | list[str], keep_blank: bool = False, first: int | None = None) -> DataFrame:
    """(file, n, value): stripped lines with their number from 1 in their file; blank ones are dropped before counting unless kept.

    Files of any size: each split of a file counts its lines, the counts of the
    splits before it (one row a split) are summed, and a line's number follows from
    its place within its split.  ``first`` keeps the first lines of each file.
    """
    stripped = _placed(spark, path).withColumn("value", strip(F.col("value")))
    kept = (stripped if keep_blank else stripped.where("value <> ''")).withColumn("at", F.monotonically_increasing_id())
    splits = kept.groupBy("file", "block").agg(F.min("at").alias("begin"), F.count("*").alias("size"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select(F.col("file").alias("_file"), F.col("block").alias("_block"), "begin", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    lines = kept.join(starts, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    numbered_ = lines.select("file", (F.col("before") + F.col("at") - F.col("begin") + 1).alias("n"), "value")
    return numbered_ if first is None else numbered_.where(F.col("n") <= first)


def whole_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, value) with one row for each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def table_lines(table: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, line): the stripped lines of a text column that aren't blank, numbered from 0 as they stand."""
    lines = table.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text(text_col), "\n")).alias("line_no", "line"))
    return lines.withColumn("line", strip(F.col("line"))).where("line <> ''")


def _quoted() -> dict[str, str]:
    """Options of CSV with line breaks inside quotes: nothing between commas is null, ``""`` is empty.

    Spark takes whatever reads like the sign of a null for one, quoted or not; so the sign is one that no text has.
    """
    return {"multiLine": "true", "escape": '"', "nullValue": uuid.uuid4().hex}


def csv_corpus(spark: SparkSession, path: str | list[str], schema: str = PARALLEL) -> DataFrame:
    """A CSV corpus with header, quotes and embedded line breaks."""
    return spark.read.options(header=True, enforceSchema=False, **_quoted()).schema(schema).csv(path)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, head, record): the records of CSV files with line breaks inside quotes, each as it stands; ``n`` orders a file's records, ``head`` is its first.

    A file of any size is read split by split.  A line begins a record if the quotes
    before it are even: those of the earlier splits are summed from one row a split,
    those of its own split by a window.  A record that runs into later splits takes its
    number from the last one begun in a split before.
    """
    lines = _placed(spark, path, "\n", True).withColumns({"at": F.monotonically_increasing_id(), "quotes": F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))})
    splits = lines.groupBy("file", "block").agg(F.sum("quotes").alias("total"), F.min("at").alias("first"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = splits.select("file", "block", "first", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("file", "block").orderBy("at")
    open_ = (F.col("before") + F.coalesce(F.sum("quotes").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) % 2 == 1
    begun = lines.join(before, ["file", "block"]).withColumns({"begin": F.when(~open_, F.struct("block", "at")), "head": (F.col("block") == 0) & (F.col("at") == F.col("first"))})
    known = begun.withColumn("own", F.max("begin").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    last = known.groupBy("file", "block").agg(F.max("own").alias("last"))
    carried = last.select("file", "block", F.max("last").over(earlier).alias("carried"))
    placed = known.join(carried, ["file", "block"]).withColumn("n", F.coalesce("own", "carried"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda x: x["value"]), "\n")
    return placed.groupBy("file", "n").agg(F.max("head").alias("head"), F.regexp_replace(whole, "\r$", "").alias("record"))


def checked_csv(spark: SparkSession, path: str, required: tuple[str, ...] = ("romanized", "devanagari")) -> DataFrame:
    """All columns of a CSV as strings; raises if a required one is missing.  A file of any size is read split by split."""
    options = _quoted()
    names = spark.read.options(header=True, **options).csv(path).columns  # reads the beginning only
    missing = [c for c in required if c not in names]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in names)
    rows = csv_records(spark, path).where("not head and record <> ''")
    return rows.select(F.from_csv("record", schema, options).alias("r")).select("r.*")


def csv_folder(spark: SparkSession, folder: str, schema: str = PARALLEL) -> DataFrame:
    """All ``.csv`` files of a folder as one frame."""
    return spark.read.options(header=True, pathGlobFilter="*.csv", **_quoted()).schema(schema).csv(folder)


def text_folder(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(file, value): the stripped lines of all ``.txt`` files."""
    reader = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", recursive)
    return reader.text(folder).select(F.col("_metadata.file_path").alias("file"), strip(F.col("value")).alias("value")).where("value <> ''")


def json_entries(spark: SparkSession, path: str) -> DataFrame:
    """(ord, entry): the members of one JSON object whose values are objects, in file order, each as an object of its own.

    The file may be of any size and have no line breaks.  It is read in fragments
    that end with a brace.  Whether a fragment begins inside a string follows from the
    quotes before it, how deep it lies from the braces before it, and which member it
    belongs to from the members that have ended before it: three running sums over
    the fragments, for which only their counts travel.
    """
    fragments = _placed(spark, path, "}").withColumn("at", F.monotonically_increasing_id())
    plain = F.regexp_replace("value", "\\\\.", "")  # an escape never parts at a brace
    after_string = F.regexp_replace("plain", '^[^"]*("|$)', "")
    outside = lambda c: F.regexp_replace(c, '"[^"]*("|$)', "")
    count = lambda c, x: (F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))).cast("long")
    counted = fragments.withColumn("plain", plain).select(
        "file", "block", "at", count(F.col("plain"), '"').alias("quotes"), count(outside(F.col("plain")), "{").alias("opened_outside"), count(outside(after_string), "{").alias("opened_inside")
    )
    order = ["file", "block", "at"]
    quoted = prefix_scan(counted, order, exclusive=True, before=("sum", F.col("quotes")))
    inside = F.coalesce(F.col("before"), F.lit(0)) % 2 == 1
    closes = ((F.coalesce(F.col("before"), F.lit(0)) + F.col("quotes")) % 2 == 0).cast("long")
    braced = quoted.select(*order, closes.alias("closes"), (F.when(inside, F.col("opened_inside")).otherwise(F.col("opened_outside")) - closes).alias("change"))
    deep = prefix_scan(braced, order, depth=("sum", F.col("change")))
    ends = ((F.col("closes") == 1) & (F.col("depth") == 1)).cast("long")
    members = prefix_scan(deep.select(*order, ends.alias("ends")), order, exclusive=True, ord=("sum", F.col("ends")))
    members = members.select(*[F.col(c).alias(f"_{c}") for c in order], F.coalesce("ord", F.lit(0)).alias("ord"), "ends")
    met = fragments.join(members, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")) & (F.col("at") == F.col("_at")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda x: x["value"]), "}")
    entries = met.groupBy("ord").agg(whole.alias("text"), F.max("ends").alias("ends")).where("ends = 1")
    return entries.select("ord", F.concat(F.regexp_replace("text", "^\\s*[{,]", "{"), F.lit("}}")).alias("entry"))


def pvd_entries(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    """(ord, code, base_word, variants) of a dictionary JSON of any size, in file order.

    A code that comes again keeps its first place and has its last value.
    ``by_line`` reads a dictionary of one entry a line; its entries are in code order.
    """
    if by_line:
        entries = spark.read.text(path).select(F.lit(None).cast("long").alias("ord"), F.col("value").alias("entry"))
    else:
        entries = json_entries(spark, path)
    each = entries.select("ord", F.explode(F.map_entries(F.from_json("entry", PVD_JSON))).alias("e"))
    rows = each.select((F.col("e.key") if by_line else F.col("ord")).alias("ord"), F.col("e.key").alias("code"), F.col("e.value.base_word").alias("base_word"), F.col("e.value.variants").alias("variants"))
    if by_line:
        return rows
    last = rows.groupBy("code").agg(F.min("ord").alias("ord"), F.max_by(F.struct("base_word", "variants"), "ord").alias("v"))
    return last.select("ord", "code", "v.base_word", "v.variants")


def pvd_lookup(entries: DataFrame) -> DataFrame:
    """(variant, base): each base maps to itself, each other variant to its base; later entries win.

    Both are stripped and lower-cased; empty ones are left out.
    """
    low = lambda c: F.lower(strip(text(c)))
    base = entries.select("ord", low(F.col("base_word")).alias("base"), F.transform(F.coalesce("variants", F.array().cast("array<string>")), lambda v: F.lower(strip(F.coalesce(v, F.lit(""))))).alias("variants")).where("base <> ''")
    pairs = base.select("ord", "base", F.posexplode(F.concat(F.array("base"), F.filter("variants", lambda v: (v != "") & (v != F.col("base"))))).alias("place", "variant"))
    last = pairs.groupBy("variant").agg(F.max_by("base", F.struct("ord", "place")).alias("base"))
    return last.select("variant", "base")


def clusters(entries: DataFrame) -> DataFrame:
    """(word, cluster): every word of an entry, lower-cased, with all words of the entry; later entries win."""
    every = F.concat(F.coalesce("variants", F.array().cast("array<string>")), F.array("base_word"))
    words = entries.select("ord", every.alias("cluster")).select("ord", "cluster", F.explode("cluster").alias("w")).where("w is not null")
    return words.groupBy(F.lower("w").alias("word")).agg(F.max_by("cluster", "ord").alias("cluster"))


def vocabulary(lines: DataFrame, column: str = "value", cleaned: bool = False) -> DataFrame:
    """Distinct lower-cased words, one a line; ``cleaned`` keeps token characters only and drops blanks."""
    word = F.lower(clean_token(strip(text(column)))) if cleaned else F.lower(strip(text(column)))
    found = lines.select(word.alias("word")).distinct()
    return found.where("word <> ''") if cleaned else found


def cased_vocabulary(lines: DataFrame, column: str = "value") -> DataFrame:
    """Distinct words as they are written."""
    return lines.select(text(column).alias("word")).where("word <> ''").distinct()


def in_order(frame: DataFrame, *order: str) -> DataFrame:
    """``frame`` with ``n``, its row number from 1; distributed (``operators.scans``)."""
    return numbered(frame, *order)
