"""Permutations, posting lists, distinct streams and table functions."""

from __future__ import annotations

import collections
import random

import pytest
from pyspark.sql import functions as F

from varnaflow.functions import tables
from varnaflow.operators import samples
from varnaflow.plans import dictionary
from varnaflow.streaming import lines as streams


@pytest.mark.parametrize("size", [1, 2, 3, 5, 100, 1000, 1025, 4097])
def test_permutation(spark, size):
    """A bijection for sizes that are no powers of two, the same each time, another for another seed, and far from the order."""
    n = spark.range(size)
    places = [r["p"] for r in n.select("id", samples.permuted(F.col("id"), size).alias("p")).orderBy("id").collect()]
    assert sorted(places) == list(range(size))
    assert places == [r["p"] for r in n.repartition(3).select("id", samples.permuted(F.col("id"), size).alias("p")).orderBy("id").collect()]
    if size >= 100:
        other = [r["p"] for r in n.select("id", samples.permuted(F.col("id"), size, seed=1).alias("p")).orderBy("id").collect()]
        assert sum(a == b for a, b in zip(places, other, strict=True)) < size / 10
        assert sum(abs(a - i) for i, a in enumerate(places)) / size > size / 5
        assert sum(b == a + 1 for a, b in zip(places, places[1:], strict=False)) < size / 10


def test_shuffled_keeps_rows(spark):
    rows = spark.createDataFrame([(f"k{i:03}", i) for i in range(77)], "k string, v int").repartition(5)
    got = samples.shuffled(rows, "k").collect()
    assert sorted(r["place"] for r in got) == list(range(77)) and {(r["k"], r["v"]) for r in got} == {(f"k{i:03}", i) for i in range(77)}
    assert samples.shuffled(rows.limit(0), "k").count() == 0


def test_null_keys_come_last_in_a_shuffle(spark):
    """As an ORDER BY without more has it: a null moves no other row's place."""
    ids = [5, 3, 9, 1, 7]
    place = lambda keys: {r["k"]: r["place"] for r in samples.shuffled(spark.createDataFrame([(k,) for k in keys], "k int"), "k").collect()}
    walk = [r["p"] for r in spark.range(6).select(samples.permuted(F.col("id"), 6).alias("p")).orderBy("id").collect()]
    assert place([None, *ids]) == dict(zip([1, 3, 5, 7, 9, None], walk, strict=True))


def test_postings_of_a_code_of_any_size(spark):
    """A code that holds nearly all words: rows stay small, and together they are the group."""
    words = [(f"w{i:06}", i % 50, "hot") for i in range(20_000)] + [("a", 1, "c"), ("b", 5, "c"), ("b2", 5, "c"), ("single", 1, "s")]
    coded = spark.createDataFrame(words, "word string, n long, code string").repartition(7)
    got = dictionary.postings_of(coded, chunk=300).collect()
    assert max(len(r["variants"]) for r in got) == 300
    whole = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r["code"], r["chunk"])):
        whole[r["code"]] += r["variants"]
    assert whole == {"hot": [w for w, _, c in words if c == "hot"], "c": ["a", "b", "b2"]}
    assert {(r["code"], r["base_word"], r["n"]) for r in got} == {("hot", "w000049", 20_000), ("c", "b", 3)}


def test_distinct_stream(spark, tmp_path):
    """The same line in three micro-batches, after a restart, and in a batch that runs again comes out once."""
    folder, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    rnd, want = random.Random(1), set()
    for _ in range(3):
        some = [f"line {rnd.randint(0, 30)}" for _ in range(40)]
        want |= set(some)
        spark.createDataFrame([(x,) for x in some], "value string").repartition(3).write.mode("append").text(folder)
        streams.append_distinct(streams.line_stream(spark, folder, files_per_batch=1), out, mark).awaitTermination()
        got = [r["value"] for r in spark.read.parquet(out).collect()]
        assert sorted(got) == sorted(want)
    batches = spark.read.parquet(out).agg(F.max("batch")).first()[0]
    assert batches >= 2
    # the last batch runs again, as after a failure between its rows and its mark
    last = sorted((tmp_path / "mark" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))[-1]
    for file in (last, last.with_name(f".{last.name}.crc")):
        if file.exists():
            file.unlink()
    streams.append_distinct(streams.line_stream(spark, folder, files_per_batch=1), out, mark).awaitTermination()
    assert sorted(r["value"] for r in spark.read.parquet(out).collect()) == sorted(want)


def test_table_functions(spark):
    tables.register(spark)
    spark.createDataFrame([("a", 1, 5.0), ("a", 2, 4.0), ("a", 3, 4.5), ("a", 4, 4.6), ("a", 5, 1.0), ("b", 1, None), ("b", 2, 2.0)], "k string, epoch int, loss double").createOrReplaceTempView("curve")
    got = [tuple(r) for r in spark.sql("SELECT k, epoch, best, waited, stopped FROM patience(TABLE(curve) PARTITION BY k ORDER BY (epoch), 'loss', 1) ORDER BY k, epoch").collect()]
    assert got == [("a", 1, 5.0, 0, False), ("a", 2, 4.0, 0, False), ("a", 3, 4.0, 1, False), ("a", 4, 4.0, 2, False), ("a", 5, 1.0, 0, True), ("b", 1, None, 1, False), ("b", 2, 2.0, 0, False)]
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM patience(TABLE(curve), 'nope', 1)").collect()
    spark.createDataFrame([(7, "Ma ghar jaanchu", {"ghar": ["ghar", "gharr"]}), (8, "", None)], "id int, text string, clusters map<string, array<string>>").createOrReplaceTempView("sentences")
    made = spark.sql("SELECT * FROM variations(TABLE(sentences), 3)").collect()
    assert [(r["id"], r["n"]) for r in sorted(made)] == [(i, n) for i in (7, 8) for n in (1, 2, 3)]
    assert {r["sentence"] for r in made if r["id"] == 7} <= {"Ma ghar jaanchu", "Ma gharr jaanchu"}
    chunks = spark.sql("SELECT n, chunk FROM text_chunks('aa bb cc ddddddd e', 5)").collect()
    assert [tuple(r) for r in chunks] == [(0, "aa bb"), (1, "cc"), (2, "ddddd"), (3, "dd"), (4, "e")]
    assert [tuple(r) for r in spark.sql("SELECT * FROM text_chunks(NULL, 5)").collect()] == [(0, "")]
