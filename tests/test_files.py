"""Large files read by splits, and single files written in parts."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from varnaflow.plans import files
from varnaflow.sources import readers, writers


@pytest.fixture
def small_splits(spark):
    """Splits of 700 bytes, so that small files have many."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for key in keys:
        spark.conf.set(key, "700")
    yield spark
    for key in keys:
        spark.conf.unset(key)


def test_line_numbers_over_many_splits(small_splits, tmp_path):
    spark, rnd = small_splits, random.Random(3)
    want = {}
    for name in ("a", "b"):
        lines = [rnd.choice(["", " ", "\t", f" line {i} ", f"é{i} " + "x" * rnd.randint(0, 90)]) for i in range(400)]
        (tmp_path / f"{name}.txt").write_text("\n".join(lines) + "\n" * (name == "a"), encoding="utf-8")
        want[name] = [x.strip() for x in lines]
    path = str(tmp_path / "*.txt")
    assert readers._placed(spark, path).select("file", "block").distinct().count() > 8
    for keep_blank, first in ((True, None), (False, None), (False, 7), (True, 7)):
        got = {"a": {}, "b": {}}
        for r in readers.numbered_lines(spark, path, keep_blank, first).collect():
            got[r["file"][-5]][r["n"]] = r["value"]
        for name, lines in want.items():
            kept = [x for x in lines if x or keep_blank][:first]
            assert got[name] == dict(enumerate(kept, 1))


def test_json_object_over_many_splits(small_splits, tmp_path):
    """Against the whole object parsed at once: braces, quotes and escapes in strings, keys that come again, no line breaks."""
    spark, rnd = small_splits, random.Random(8)
    odd = ["{", "}", '"', "\\", "a", "é", "}}", '\\"', "{\\", " ", ",", '":{', "\n", "]", "u0041"]
    word = lambda: "".join(rnd.choice(odd) for _ in range(rnd.randint(0, 9)))
    members = [(word() + str(rnd.randint(0, 150)), {"base_word": word(), "variants": [word() for _ in range(rnd.randint(0, 5))]}) for _ in range(300)]
    for i, (left, sep, right, ascii_only) in enumerate([("{", ",", "}", True), (" {\n ", " ,\n", " }\n", False)]):
        file = tmp_path / f"{i}.json"
        file.write_text(left + sep.join(f"{json.dumps(k, ensure_ascii=ascii_only)}: {json.dumps(v, ensure_ascii=ascii_only)}" for k, v in members) + right, encoding="utf-8")
        want = json.loads(file.read_text(encoding="utf-8"))
        assert readers._placed(spark, str(file), "}").select("block").distinct().count() > 5
        got = sorted(readers.pvd_entries(spark, str(file)).collect(), key=lambda r: r["ord"])
        assert [(r["code"], r["base_word"], r["variants"]) for r in got] == [(k, v["base_word"], v["variants"]) for k, v in want.items()]
    (tmp_path / "none.json").write_text("{}", encoding="utf-8")
    assert readers.pvd_entries(spark, str(tmp_path / "none.json")).count() == 0


def test_one_file_in_order(spark, tmp_path):
    rows = [(i, "" if i % 9 == 0 else f"v{i}é" * (i % 5)) for i in range(2000)]
    frame = spark.createDataFrame(rows, "i int, v string").repartition(7)
    path = str(tmp_path / "deep" / "one.txt")
    writers.write_one_file(frame, path, F.col("v"), [-F.col("i")], header="head\n", bom=True)
    want = b"\xef\xbb\xbfhead\n" + "".join(v + "\n" for _, v in reversed(rows)).encode()
    assert (tmp_path / "deep" / "one.txt").read_bytes() == want
    writers.write_one_file(frame.limit(0), path, F.col("v"), ["i"], header="head\n")
    assert (tmp_path / "deep" / "one.txt").read_bytes() == b"head\n"
    same = spark.range(3000).select(F.lit(1).alias("o"), F.lit("x").alias("v"))
    writers.write_one_file(same, path, F.col("v"), ["o"], separator=", ", header="[", footer="]")
    assert (tmp_path / "deep" / "one.txt").read_text() == "[" + ", ".join(["x"] * 3000) + "]"


def test_a_failed_export_leaves_no_trace(spark, tmp_path):
    path = tmp_path / "kept.txt"
    path.write_text("as it was")
    bad = F.when(F.col("id") == 900, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string"))
    with pytest.raises(Exception, match="no"):
        writers.write_one_file(spark.range(1000), str(path), bad, ["id"])
    assert path.read_text() == "as it was" and [p.name for p in tmp_path.iterdir()] == ["kept.txt"]
    with pytest.raises(ValueError, match="mounted|place"):
        writers.write_one_file(spark.range(1), "s3a://b/x", F.col("id"), ["id"])


def test_csv_file_with_mark(spark, tmp_path):
    rows = [(1, 'a "b", c', "x\ny"), (2, None, ""), (3, " lead ", "z")]
    path = str(tmp_path / "t.csv")
    writers.write_csv_file(spark.createDataFrame(rows, "id int, romanized string, devanagari string"), path, ["id"])
    assert (tmp_path / "t.csv").read_text(encoding="utf-8") == '\ufeffid,romanized,devanagari\n1,"a ""b"", c","x\ny"\n2,,\n3, lead ,z\n'
    assert readers.checked_csv(spark, path).columns == ["id", "romanized", "devanagari"]


def test_one_csv_file_is_read_by_many_tasks(spark, tmp_path):
    """Quotes, line breaks and carriage returns inside values, over splits of 1 KB, one value longer than a split."""
    texts = [f'a "{i}"\nb,{i}\r\n\nc' if i % 3 else f"plain {i}" for i in range(300)] + ["x\n" * 3000, '"', "\n", "", "last"]
    rows = spark.createDataFrame([(i, t, f"d{i}") for i, t in enumerate(texts)], "id int, romanized string, devanagari string")
    path = f"{tmp_path}/all.csv"
    writers.write_csv_file(rows, path, ["id"])
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        assert readers._placed(spark, path, "\n", True).rdd.getNumPartitions() > 10
        got = {r["id"]: (r["romanized"], r["devanagari"]) for r in readers.checked_csv(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got == {str(i): (t or None, f"d{i}") for i, t in enumerate(texts)}


@pytest.fixture(scope="module")
def odd_documents(spark, tmp_path_factory):
    """Empty texts beside nulls, alone and together, and signs that a reader of CSV may take for its own."""
    values = ["", None, '"', '""', ",", "\r", "\n", "a\r\nb", "\\", 'a\\"', " ", "\x00", "\ufeff", "\uffff", "\uffffa", "null", "-", "\u2028", "é"]
    rows = [(i, t, "s") for i, t in enumerate(values)] + [(100 + i, "t", t) for i, t in enumerate(values)] + [(200 + i, t, t) for i, t in enumerate(values)] + [(None, "", ""), (None, None, None)]
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    md5 = lambda t: t if t is None else hashlib.md5(t.encode()).hexdigest()
    return path, sorted(((i, md5(t), s) for i, t, s in rows), key=repr)


def test_empty_texts_in_one_csv_file(spark, odd_documents):
    path, want = odd_documents
    got = files.checked_csv_rows(spark, path).collect()
    assert sorted(((r["id"] and int(r["id"]), r["romanized"], r["devanagari"]) for r in got), key=repr) == want


def test_empty_texts_in_csv_folders(spark, odd_documents, tmp_path):
    path, want = odd_documents
    assert sorted(map(tuple, files.csv_rows(spark, path).collect()), key=repr) == want
    turns = [("", "user"), (None, "user"), ("", ""), ("x", None)]
    spark.createDataFrame(turns, "text string, role string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted(map(tuple, files.csv_folder_rows(spark, str(tmp_path)).collect()), key=repr) == sorted(((*t, 1) for t in turns), key=repr)
