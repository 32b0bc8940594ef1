"""Queries over files and services: tables are written by the sinks and read again by the sources.

Files go to a new folder of the shared store.  Each query's SQL is over the table
that the files were made from, so a row lost or changed on the way shows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip, words
from ..operators.scans import numbered
from ..session import new_path, ship
from ..sources import clients, readers, writers
from ..streaming import lines as streams

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}
_BLANK = "\\x{0009}-\\x{000D}\\x{001C}-\\x{0020}\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _FOUND[f.__name__] = (f, sql)
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _md5(c: str):  # noqa: ANN202
    return F.md5(F.col(c).cast("binary"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("romanized"), F.col("source").alias("devanagari"))


@_query("SELECT doc_id AS id, md5(text) AS romanized, source AS devanagari FROM documents")
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC5 SNK2 D2 D3: all documents as CSV and back, with quotes and line breaks inside."""
    path = new_path(spark, "csv")
    writers.write_csv(_labelled(spark, sf_dir), path)
    return readers.csv_corpus(spark, path, readers.LABELLED).select("id", _md5("romanized").alias("romanized"), "devanagari")


@_query("SELECT doc_id::VARCHAR AS id, md5(text) AS romanized, source AS devanagari FROM documents")
def checked_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC6 SNK4: the same as one file with a byte-order mark, all columns as strings, required ones checked."""
    path = f"{new_path(spark, 'csv')}/all.csv"
    writers.write_csv_file(_labelled(spark, sf_dir), path, ["id"], keep_empty=True)
    return readers.checked_csv(spark, path).select("id", _md5("romanized").alias("romanized"), "devanagari")


@_query("SELECT text AS romanized, role AS devanagari, count(*) AS n FROM conversations GROUP BY ALL")
def csv_folder_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC7 SNK2: a folder of CSV files as one table; its other files are not read."""
    path, turns = new_path(spark, "folder"), _table(spark, sf_dir, "conversations").select(F.col("text").alias("romanized"), F.col("role").alias("devanagari"))
    writers.write_csv(turns.where("devanagari = 'user'"), path, mode="append")
    writers.write_csv(turns.where("devanagari <> 'user' or devanagari is null"), path, mode="append")
    turns.select("romanized").limit(1).write.mode("append").text(path)
    return readers.csv_folder(spark, path).groupBy("romanized", "devanagari").agg(F.count("*").alias("n"))


@_query("SELECT conv_id, turn, text FROM conversations UNION ALL SELECT item_id, -1, text FROM benchmark")
def appended_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK3: rows appended to a table that the first append makes."""
    path = new_path(spark, "rows")
    writers.append_rows(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), path)
    writers.append_rows(_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("conv_id"), F.lit(-1).cast(_table(spark, sf_dir, "conversations").schema["turn"].dataType).alias("turn"), "text"), path)
    return spark.read.parquet(path)


def _sql_lines(column: str, table: str) -> str:
    return f"SELECT regexp_replace(v, '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g') AS value FROM (SELECT unnest(string_split({column}, chr(10))) AS v FROM {table})"


@_query(f"SELECT md5(value) AS line, count(*) AS n FROM ({_sql_lines('text', 'documents')}) WHERE value <> '' GROUP BY 1")
def text_file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1 SNK1: the lines of all documents as text files and back."""
    path = new_path(spark, "lines")
    writers.write_lines(_table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value")), path)
    return readers.text_lines(spark, path).groupBy(_md5("value").alias("line")).agg(F.count("*").alias("n"))


@_query("SELECT item_id, md5(text || chr(10)) AS content FROM benchmark")
def whole_file_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC4 SNK6: a file for each item, read whole."""
    path = new_path(spark, "whole")
    _table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("value")).repartition("item_id").write.partitionBy("item_id").text(path)
    files = readers.whole_files(spark, f"{path}/*")
    return files.select(F.regexp_extract("file", "item_id=([0-9]+)/", 1).cast("long").alias("item_id"), _md5("value").alias("content"))


@_query(f"""WITH top AS ({_sql_lines('text', 'benchmark')}), deep AS ({_sql_lines('text', 'conversations')})
  SELECT 'flat' AS how, md5(value) AS line, count(*) AS n FROM top WHERE value <> '' GROUP BY 2
  UNION ALL SELECT 'recursive', md5(value), count(*) FROM (FROM top UNION ALL FROM deep) WHERE value <> '' GROUP BY 2""")
def text_folder_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC8 SRC9: the ``.txt`` files of a folder, with and without those of folders inside it."""
    path = new_path(spark, "texts")
    for table, folder in (("benchmark", path), ("conversations", f"{path}/deep/er")):
        _table(spark, sf_dir, table).select(F.col("text").alias("value")).write.mode("append").text(folder)
    counted = lambda how, recursive: readers.text_folder(spark, path, recursive).groupBy(F.lit(how).alias("how"), _md5("value").alias("line")).agg(F.count("*").alias("n"))
    return counted("flat", False).unionByName(counted("recursive", True))


@_query(f"""WITH w AS (SELECT unnest(list_append(list_filter(regexp_split_to_array(text, '[{_BLANK}]+'), lambda x: x <> ''), '')) AS w FROM benchmark)
  SELECT DISTINCT 'lower' AS kind, lower(w) AS word FROM w UNION ALL SELECT DISTINCT 'cased', w FROM w WHERE w <> ''
  UNION ALL SELECT DISTINCT 'cleaned', lower(regexp_replace(w, '[^A-Za-z0-9\\x{{0900}}-\\x{{097F}}'']+', '', 'g')) FROM w WHERE regexp_replace(w, '[^A-Za-z0-9\\x{{0900}}-\\x{{097F}}'']+', '', 'g') <> ''""")
def vocabularies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC12 SRC13 SRC14: word lists from a file of one word a line: lower-cased with blanks, cleaned, and as written."""
    path = new_path(spark, "vocabulary")
    listed = F.concat(words(F.col("text")), F.array(F.lit("")))
    writers.write_lines(_table(spark, sf_dir, "benchmark").select(F.explode(listed).alias("value")), path)
    lines = spark.read.text(path)
    kinds = {"lower": readers.vocabulary(lines), "cleaned": readers.vocabulary(lines, cleaned=True), "cased": readers.cased_vocabulary(lines)}
    first, second, third = (frame.select(F.lit(kind).alias("kind"), "word") for kind, frame in kinds.items())
    return first.unionByName(second).unionByName(third)


@_query("SELECT role, turn, count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY ALL")
def rows_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK6: a folder for each key, read as one table."""
    path = new_path(spark, "keys")
    writers.write_by_key(_table(spark, sf_dir, "conversations").select("role", "turn", "text"), path, "role")
    return spark.read.parquet(path).groupBy("role", "turn").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@_query("SELECT 1 AS n, 'url' AS value UNION ALL SELECT row_number() OVER (ORDER BY page_id, url) + 1, url FROM pages")
def column_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK7: a column as one text file in order, whose first line is its name."""
    path = f"{new_path(spark, 'column')}/url.txt"
    writers.write_one_file(_table(spark, sf_dir, "pages"), path, F.col("url"), ["page_id"], header="url\n")
    return readers.numbered_lines(spark, path).select("n", "value")


@_query(f"SELECT md5(value) AS line, count(*) AS n FROM ({_sql_lines('text', 'benchmark')} UNION ALL {_sql_lines('text', 'conversations')}) WHERE value <> '' GROUP BY 1")
def merged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK8: the lines of several folders in one."""
    parts = [new_path(spark, name) for name in ("benchmark", "conversations")]
    for table, path in zip(("benchmark", "conversations"), parts, strict=True):
        writers.write_lines(_table(spark, sf_dir, table), path, "text")
    merged = new_path(spark, "merged")
    writers.merge_texts(spark, parts, merged)
    return readers.text_lines(spark, merged).groupBy(_md5("value").alias("line")).agg(F.count("*").alias("n"))


@_query(f"SELECT md5(value) AS line, count(*) AS n FROM ({_sql_lines('text', 'benchmark')} UNION ALL {_sql_lines('text', 'conversations')}) WHERE value <> '' GROUP BY 1")
def streamed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row streaming: files that arrive before and between two runs of a stream, each line once."""
    folder, out, mark = (new_path(spark, name) for name in ("arriving", "streamed", "progress"))
    for table in ("benchmark", "conversations"):
        _table(spark, sf_dir, table).select(F.col("text").alias("value")).write.mode("append").text(folder)
        streams.append_all(streams.line_stream(spark, folder), out, mark).awaitTermination()
    return spark.read.parquet(out).groupBy(_md5("value").alias("line")).agg(F.count("*").alias("n"))


@_query(f"SELECT md5(value) AS line, 1::BIGINT AS n FROM (SELECT DISTINCT value FROM ({_sql_lines('text', 'benchmark')} UNION ALL {_sql_lines('text', 'conversations')}) WHERE value <> '')")
def streamed_distinct_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incremental dedup of a stream: lines that come in several micro-batches, and again after restarts, once each."""
    folder, out, mark = (new_path(spark, name) for name in ("arriving", "distinct", "progress"))
    for table in ("benchmark", "conversations", "benchmark"):
        _table(spark, sf_dir, table).select(F.col("text").alias("value")).write.mode("append").text(folder)
        streams.append_distinct(streams.line_stream(spark, folder, files_per_batch=2), out, mark).awaitTermination()
    return spark.read.parquet(out).groupBy(_md5("value").alias("line")).agg(F.count("*").alias("n"))


def _backwards(batch: list[str]) -> list[str]:
    return [x[::-1] for x in batch]


@_query("SELECT conv_id, turn, reverse(text) AS output FROM conversations")
def model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC17: an injected model over batches; outputs keep their rows."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return clients.infer(turns, "text", _backwards).select("conv_id", "turn", "output")


def _numbered(batch: list[str]) -> str:
    return "\n".join(f"{k}. {x[::-1]}" for k, x in enumerate(batch, 1))


@_query("SELECT item_id + 1000 AS id, translate(text, chr(10), ' ') AS romanized, reverse(translate(text, chr(10), ' ')) AS devanagari FROM benchmark")
def labelled_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC19: batches of ten labelled by an injected service with numbered answers."""
    rows = _table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1).alias("n"), F.translate("text", "\n", " ").alias("value"))
    return clients.label_batches(rows, _numbered, 10, 999)


def _listed(size: int) -> str:
    return "\n".join(f"word{k} , शब्द{k}" for k in range(size)) + "\nno pair here"


@_query("SELECT 'word' || i % 15 AS romanized, 'शब्द' || i % 15 AS devanagari FROM (SELECT unnest(range(3000)) AS i)")
def generated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC20 FLT14: answers of an injected generator parsed to pairs, up to the total asked for."""
    return clients.generate_pairs(ship(spark), _listed, 3000, 15)


def _channel(name: str) -> list[str]:
    return [f"{name}/{k}" for k in range(len(name) % 4)]


@_query("SELECT lang AS channel, lang || '/' || unnest(range(length(lang) % 4)) AS video FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)")
def channel_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC15: the videos of each channel by an injected listing."""
    channels = [r[0] for r in _table(spark, sf_dir, "documents").select("lang").where("lang is not null").distinct().collect()]  # one row a language
    return clients.channel_videos(_channel, channels, spark)


def paged(video: str, token: str | None, key: int) -> tuple[list[str], str | None]:
    """A stand-in for the comment service: three pages of two comments; the first key's quota ends after one page."""
    page = int(token or 0)
    if page and key == 0:
        raise clients.ServiceError(403, "quotaExceeded")
    return [f"{video} {2 * page}", f"{video} {2 * page + 1}"], str(page + 1) if page < 2 else None


@_query("SELECT role AS video, i::INT AS n, role || ' ' || i AS comment FROM (SELECT DISTINCT role FROM conversations WHERE role IS NOT NULL), (SELECT unnest(range(6)) AS i)")
def paged_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC16: all pages of each video's comments, with the next key once a quota is used up."""
    ship(spark).dataSource.register(clients.CommentSource)
    videos = sorted(r[0] for r in _table(spark, sf_dir, "conversations").select("role").where("role is not null").distinct().collect())  # a few roles
    return spark.read.format("video_comments").option("videos", ",".join(videos)).option("client", f"{__name__}:paged").option("keys", 2).load()


#: The lines of all documents with the document's number before each, made longer so that a file has several splits.
_LONG_LINES = "SELECT doc_id, i, CASE WHEN v = '' THEN '' ELSE doc_id || ' ' || repeat(md5(v), 40) END AS v FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS v, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"


@_query(f"""WITH l AS ({_LONG_LINES}) SELECT 'all' AS how, row_number() OVER (ORDER BY doc_id, i) AS n, md5(v) AS line FROM l
  UNION ALL SELECT * FROM (SELECT 'not blank', row_number() OVER (ORDER BY doc_id, i) AS n, md5(v) FROM l WHERE v <> '')
  UNION ALL SELECT * FROM (SELECT 'first', row_number() OVER (ORDER BY doc_id, i) AS n, md5(v) FROM l WHERE v <> '') WHERE n <= 500""")
def numbered_file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC2 SRC3: line numbers of one large file, read split by split; with blanks, without them, and the first of them."""
    path = f"{new_path(spark, 'numbered')}/lines.txt"
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "v"))
    longer = F.when(F.col("v") == "", F.lit("")).otherwise(F.concat("doc_id", F.lit(" "), F.repeat(_md5("v"), 40)))
    writers.write_one_file(lines, path, longer, ["doc_id", "i"])
    read = lambda how, **options: readers.numbered_lines(spark, path, **options).select(F.lit(how).alias("how"), "n", _md5("value").alias("line"))
    return read("all", keep_blank=True).unionByName(read("not blank")).unionByName(read("first", first=500))


#: Entries of a dictionary with odd characters in strings; each code comes again further down.
_ENTRIES = """SELECT item_id * 2 + again AS ord, 'c' || item_id % 37 || '"{' AS code, word || chr(92) || '}' AS base_word, [word, word || '"', '{' || item_id, '', upper(word)] AS variants FROM (
  SELECT item_id, again, md5(text || again) AS word FROM (SELECT item_id, text, unnest([0, 1]) AS again FROM (SELECT item_id, text FROM benchmark UNION ALL SELECT 1000000 + conv_id * 1000 + turn, text FROM conversations)))"""


@_query(f"SELECT code, arg_max(base_word, ord) AS base_word, array_to_string(arg_max(variants, ord), ' ') AS variants, row_number() OVER (ORDER BY min(ord)) AS place FROM ({_ENTRIES}) GROUP BY code")
def dictionary_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC10 SNK5: a dictionary written as one JSON object without line breaks and read back by fragments; later entries win."""
    read = readers.pvd_entries(spark, _dictionary_file(spark, sf_dir))
    return numbered(read, "ord", name="place").select("code", "base_word", F.array_join("variants", " ").alias("variants"), "place")


def _dictionary_file(spark: SparkSession, sf_dir: str) -> str:
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long"), "text")
    turns = _table(spark, sf_dir, "conversations").select((1_000_000 + F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"), "text")
    twice = items.unionByName(turns).withColumn("again", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("word", F.md5(F.concat("text", "again").cast("binary")))
    variants = F.array("word", F.concat("word", F.lit('"')), F.concat(F.lit("{"), "item_id"), F.lit(""), F.upper("word"))
    entries = twice.select((F.col("item_id") * 2 + F.col("again")).alias("ord"), F.concat(F.lit("c"), F.col("item_id") % 37, F.lit('"{')).alias("code"), F.concat("word", F.lit("\\}")).alias("base_word"), variants.alias("variants"))
    path = f"{new_path(spark, 'dictionary')}/pvd.json"
    writers.pvd_json(entries, path, ["ord"])
    return path


@_query(f"""WITH e AS (SELECT code, arg_max(base_word, ord) AS base_word, arg_max(variants, ord) AS variants, min(ord) AS ord FROM ({_ENTRIES}) GROUP BY code),
  w AS (SELECT unnest(list_append(variants, base_word)) AS w, list_append(variants, base_word) AS cluster, ord FROM e)
  SELECT lower(w) AS word, array_to_string(arg_max(cluster, ord), ' ') AS cluster FROM w GROUP BY 1""")
def clusters_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC11: augmentation clusters read from a JSON object; a word of several entries has the last one's cluster."""
    found = readers.clusters(readers.pvd_entries(spark, _dictionary_file(spark, sf_dir)))
    return found.select("word", F.array_join("cluster", " ").alias("cluster"))


@_query(f"""WITH e AS (SELECT lower(arg_max(base_word, ord)) AS base, arg_max(variants, ord) AS variants, min(ord) AS ord FROM ({_ENTRIES}) GROUP BY code),
  p AS (SELECT base, base AS variant, ord, 0 AS i FROM e UNION ALL SELECT base, lower(v), ord, i FROM (SELECT base, ord, unnest(variants) AS v, generate_subscripts(variants, 1) AS i FROM e) WHERE v <> '' AND lower(v) <> base)
  SELECT variant, arg_max(base, (ord, i)) AS base FROM p GROUP BY variant""")
def lookup_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC10 D5: variant to base of a dictionary file, later entries over earlier ones."""
    return readers.pvd_lookup(readers.pvd_entries(spark, _dictionary_file(spark, sf_dir)))


@_query(f"""SELECT md5(v) AS line, count(*) AS n FROM (SELECT regexp_replace(regexp_replace(v, '[^\\x{{0900}}-\\x{{097F}}{_BLANK}]', '', 'g'), '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g') AS v FROM (
  SELECT text || ' देव १२ ' || turn AS v FROM conversations)) WHERE v <> '' GROUP BY 1""")
def corpus_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK9 FLT11: the Devanagari of lines as one corpus file."""
    path = new_path(spark, "corpus")
    rows = _table(spark, sf_dir, "conversations").select(F.concat("text", F.lit(" देव १२ "), "turn").alias("value"))
    writers.corpus_text(rows, path)
    return spark.read.text(path, lineSep="\n").where("value <> ''").groupBy(F.md5(strip(F.col("value")).cast("binary")).alias("line")).agg(F.count("*").alias("n"))


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items() if sql}
