from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from varnaflow.functions.normalize import vocabulary_test
from varnaflow.operators import aggregates, filters, joins, samples, scans, sets, windows
from varnaflow.plans import dictionary, evaluation, normalization, romanized
from varnaflow.sources import clients, readers, writers
from varnaflow.streaming import lines as streams


def test_changes(spark):
    rows = spark.createDataFrame([(1, "xa timi xw ok"), (2, ""), (3, None)], "id int, t string")
    pvd = spark.createDataFrame([("timi", "timi"), ("chha", "chhan")], "variant string, base string")
    out = {r["id"]: r for r in normalization.normalize_with_changes(rows, "t", vocabulary_test(["ok"]), pvd, "id").collect()}
    assert out[1]["normalized"] == "chhan timi chhan ok"
    assert [c["rule"] for c in out[1]["changes"]] == ["x → chh", "dictionary mapping", "dictionary mapping", "x → chh", "w → a", "dictionary mapping"]
    assert out[1]["changes"][5]["original"] == "xw"
    assert (out[2]["normalized"], out[2]["changes"], out[3]["normalized"]) == ("", [], "")


def test_arms_and_ablation(spark):
    rows = spark.createDataFrame([(1, "Xa, TIMI timi")], "id int, t string")
    pvd = spark.createDataFrame([("timi", "tapai")], "variant string, base string")
    got = {r["config"]: r["normalized"] for r in normalization.arms(rows, "t", vocabulary_test([]), pvd, "id").collect()}
    assert got == {"combined": "chha, tapai tapai", "rule_based": "chha, timi timi", "pvd_only": "Xa, TIMI tapai", "raw": "Xa, TIMI timi"}
    assert normalization.ablation(rows, "t", vocabulary_test([]), pvd, [("a", 125), ("b", 0)], None, "id").count() == 8


def test_romanized(spark):
    lines = spark.createDataFrame([("the of and to",), ("mero naam ram ho",), ("😀",), ("ram(ko) ghar tyaha cha",)], "value string")
    kept, stats = romanized.romanized_corpus(lines, vocabulary_test(["the", "of", "and", "to"]))
    assert {r["sentence"] for r in kept.collect()} == {"mero naam ram ho", "ram ko ghar tyaha cha"}
    s = stats.first()
    assert (s["original_sentences"], s["cleaned_sentences"], s["romanized_sentences"], s["removed_both_issues"], s["emoji_fixes"], s["separator_fixes"]) == (4, 3, 2, 1, 1, 1)
    empty = romanized.romanized_corpus(lines.limit(0), vocabulary_test(["the"]))[1].first()
    assert (empty["success_rate"], empty["min_genuine_words"]) == (0.0, 0)


def test_augmented_has_four_rows(spark):
    rows = spark.createDataFrame([(1, "ma ghar"), (2, "")], "id int, t string")
    clusters = spark.createDataFrame([("ghar", ["ghar", "gharr"])], "word string, cluster array<string>")
    out = dictionary.augmented(rows, "t", clusters).collect()
    assert sorted((r["id"], r["variation"]) for r in out) == [(i, v) for i in (1, 2) for v in range(4)]
    assert all(r["sentence"].startswith("ma ghar") for r in out if r["id"] == 1)


def test_clusters_as_rows_are_not_copied_for_each_word(spark):
    """A group of 2,000 words gives 2,000 rows of one word, whose variations are those of arrays, and nothing of it is broadcast."""
    variants = sorted(f"gh{i:04}" for i in range(2000))
    groups = spark.createDataFrame([("K", "gh0000", variants, 2000)], "code string, base_word string, variants array<string>, n long")
    rows = spark.createDataFrame([(i, f"Ma GH{i:04} gh{i + 1:04}") for i in range(50)] + [(99, None)], "id int, t string")
    known, members = dictionary.members_of(groups)
    assert known.count() == members.count() == 2000 and {f.dataType.typeName() for f in [*known.schema, *members.schema]} <= {"string", "integer"}
    got = dictionary.augmented_by_members(rows, "t", known, members)
    want = dictionary.augmented(rows, "t", spark.createDataFrame([(w, variants) for w in variants], "word string, cluster array<string>"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" one \n\n two\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text('romanized,devanagari\n"a, b","ए"\n', encoding="utf-8")
    (tmp_path / "p.json").write_text('{"K": {"base_word": "Ka", "variants": ["kaa", "KA ", ""]}, "L": {"base_word": "kaa", "variants": []}}', encoding="utf-8")
    base = str(tmp_path)
    assert [r["value"] for r in readers.text_lines(spark, f"{base}/a.txt").collect()] == ["one", "two"]
    assert [(r["n"], r["value"]) for r in readers.numbered_lines(spark, f"{base}/a.txt", keep_blank=True).orderBy("n").collect()] == [(1, "one"), (2, ""), (3, "two")]
    assert readers.csv_corpus(spark, f"{base}/b.csv").first()["romanized"] == "a, b"
    assert readers.csv_folder(spark, base).count() == 1
    assert readers.text_folder(spark, base).count() == 2
    entries = readers.pvd_entries(spark, f"{base}/p.json")
    assert {(r["variant"], r["base"]) for r in readers.pvd_lookup(entries).collect()} == {("ka", "ka"), ("kaa", "kaa")}
    assert {r["word"] for r in readers.clusters(entries).collect()} == {"ka", "ka ", "kaa", ""}
    writers.write_lines(spark.createDataFrame([("x",)], "value string"), f"{base}/out")
    assert [r["value"] for r in spark.read.text(f"{base}/out").collect()] == ["x"]
    writers.write_by_key(spark.createDataFrame([("m", 1), ("n", 2)], "model string, v int"), f"{base}/keys", "model")
    assert spark.read.parquet(f"{base}/keys").where("model = 'm'").count() == 1
    try:
        readers.checked_csv(spark, f"{base}/b.csv", ("nope",))
        raise AssertionError
    except ValueError:
        pass


def test_row_numbers(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    got = readers.in_order(rows, "k").collect()
    assert all(r["n"] == r["k"] + 1 for r in got)


def test_clients(spark):
    rows = spark.createDataFrame([(i, f"w{i}") for i in range(1, 13)], "n int, value string")
    labelled = clients.label_batches(rows, lambda batch: "\n".join(f"{i}. {x}!" for i, x in enumerate(batch, 1) if i < 10)).collect()
    assert len(labelled) == 11
    assert {(r["romanized"], r["devanagari"]) for r in labelled} == {(f"w{i}", f"w{i}!") for i in (*range(1, 10), 11, 12)}
    assert {r["output"] for r in clients.infer(rows, "value", lambda xs: [x.upper() for x in xs]).collect()} == {f"W{i}" for i in range(1, 13)}
    assert clients.generate_pairs(spark, lambda n: "ka, क\nbad\nkha, ख", 3).count() == 2
    waits = []
    answers = iter([clients.ServiceError(429), clients.ServiceError(503), 5])

    def call():
        x = next(answers)
        if isinstance(x, Exception):
            raise x
        return x

    assert clients.call_with_retry(call, wait=waits.append) == 5
    assert waits == [1.0, 2.0]


def test_windows_and_aggregates(spark):
    curve = spark.createDataFrame([(0, 5.0), (1, 4.0), (2, 6.0), (3, 6.0), (4, 6.0), (5, 3.0)], "epoch int, val_loss double")
    got = {r["epoch"]: (r["waited"], r["stopped"]) for r in windows.early_stop(curve, patience=2).collect()}
    assert got[4] == (3, False)
    assert got[5][1] is True
    metrics = spark.createDataFrame([("a", 1, None, 0.5, 0.1), ("b", 2, 0.3, 0.5, 0.2), ("c", 3, 0.3, 0.4, None)], "config string, ord int, cer double, wer double, bleu double")
    best = aggregates.best_by_metric(metrics, "config", "ord").first()
    assert (best["best_cer"], best["best_wer"], best["best_bleu"]) == ("b", "c", "b")
    assert [r["value"].split()[0] for r in evaluation.report_lines(metrics).collect()] == ["b", "c", "a"]
    ref = spark.createDataFrame([(1, "a b"), (2, "c")], "n int, value string")
    hyp = spark.createDataFrame([("x", 1, "a b"), ("x", 2, "d"), ("x", 3, "z")], "config string, n int, value string")
    e = evaluation.evaluate(ref, hyp, "config").first()
    assert abs(e["cer"] - 1 / 5) < 1e-9
    assert abs(e["wer"] - 1 / 3) < 1e-9


def test_sets_samples_filters(spark):
    rows = spark.range(50).withColumn("t", F.repeat(F.lit("x"), F.col("id").cast("int")))
    assert samples.sample_rows(rows, 10, "id").count() == 10
    assert samples.split_rows(rows, "id", 0.2, 40, ("t",)).where("split = 'val'").count() >= 10
    assert samples.split_rows(rows, "id", 0).where("split = 'val'").count() == 0
    assert sets.first_of_key(spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "id int, o int, v string"), "id", "o").first()["v"] == "a"
    issues = spark.createDataFrame([("paryawaran", "वातावरण"), ("a", ""), ("aaaa", "क")], "r string, d string").select(filters.pair_issues(F.col("r"), F.col("d")).alias("i")).collect()
    assert [len(r["i"]) for r in issues] == [1, 1, 1]
    assert filters.unlike(spark.createDataFrame([("abc", "xyz"), ("abc", "abc")], "a string, b string"), "a", "b").count() == 1
    edits = spark.createDataFrame([(1, 1, "x", "y"), (1, 2, "z", None)], "row int, seq int, new_romanized string, new_devanagari string")
    out = joins.overlay_edits(spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "row int, romanized string, devanagari string"), edits)
    assert {(r["row"], r["romanized"], r["devanagari"]) for r in out.collect()} == {(1, "z", "b"), (2, "c", "d")}


def test_streams_append_new_files_only(spark, tmp_path):
    source, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    source.mkdir()
    (source / "1.txt").write_text("a\n\n b \n", encoding="utf-8")
    streams.append_all(streams.line_stream(spark, str(source)), out, mark).awaitTermination()
    (source / "2.txt").write_text("c\n", encoding="utf-8")
    streams.append_all(streams.line_stream(spark, str(source)), out, mark).awaitTermination()
    assert sorted(r["value"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_prefix_scan(spark, keys):
    """Against running values of one sorted list; nulls, ties and a key that holds most rows."""
    rows = [(i, None if i % 7 == 0 else i * 37 % 101, "hot" if i % 5 else None if i % 2 else "cold") for i in range(3000)]
    frame = spark.createDataFrame(rows, "o int, v int, k string").repartition(6)
    for exclusive in (False, True):
        got = {r["o"]: r for r in scans.prefix_scan(frame, ["o"], keys, exclusive, total=("sum", F.col("v")), low=("min", F.col("v")), high=("max", F.col("v"))).collect()}
        assert len(got) == len(rows)
        seen: dict = {}
        for o, v, k in rows:
            before = seen.setdefault(k if keys else 0, [])
            if not exclusive and v is not None:
                before.append(v)
            want = (sum(before), min(before), max(before)) if before else (None, None, None)
            assert (got[o]["total"], got[o]["low"], got[o]["high"]) == want
            if exclusive and v is not None:
                before.append(v)
    same = scans.numbered(spark.range(2000).select(F.lit(1).alias("o"), "id"), "o")
    assert sorted(r["n"] for r in same.collect()) == list(range(1, 2001))
    assert scans.numbered(frame.limit(0), "o").count() == 0


def test_scan_reads_no_whole_table_in_one_task(spark):
    """Only the states, one row a range, meet in one partition."""
    plan = scans.prefix_scan(spark.range(100).withColumn("v", F.col("id")), ["id"], s=("sum", F.col("v")))._jdf.queryExecution().executedPlan().toString()
    single = plan.index("SinglePartition")
    assert "HashAggregate" in plan[single:] and plan.count("SinglePartition") == 1
