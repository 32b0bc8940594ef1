"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for each operator and stage."""

from __future__ import annotations

import collections
import random

import pytest
from pyspark.sql import functions as F

from varnaflow.llm import decontaminate, encoding, licences, packing, pii, quality, similar, simhash, suffix_dedup, token_store, window_dedup

#: Names that operators and stages use inside.
INNER = "cotrained bad_id bad_row vf_own vf_rep vf_row ROW rep keys spans key span_id span_row bucket step chunk fp group slot component print every hit_id tie label item_id".split()
PASSAGE = " ".join(f"word{i}" for i in range(60))
MIT = "Released under the MIT License."


def _rows():
    rnd = random.Random(1)
    long = " ".join(rnd.choice(["alpha", "beta", "gamma", "Delta", "x"]) + str(rnd.randint(0, 9999)) for _ in range(30_000))
    texts = [None, "", " \n\t", PASSAGE, PASSAGE, PASSAGE + " more", long, long + " " + PASSAGE + "\n" + MIT + "\nmail me at a@b.co", "short", None]
    ids = [1, 2, 3, 4, 4, None, 6, 7, None, None]
    return list(zip(ids, texts, strict=True)), long


@pytest.fixture(scope="module")
def docs(spark):
    rows, _ = _rows()
    names = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in INNER)
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *["?"] * len(INNER)) for i, t in rows], names)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(10, " ".join(PASSAGE.split()[5:30]), "x"), (10, " ".join(PASSAGE.split()[5:30]), "x"), (11, "short", "x"), (12, None, "x"), (None, "short", "x")], "item_id long, text string, row string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 0), (4, 1, 0), (4, 0, 1), (6, None, None), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")


def operators(items, labels):
    path = encoding.tokenizer_path()
    return {
        "simhash": simhash.near_duplicates,
        "licences": licences.scan_licences,
        "decontaminate": lambda d: decontaminate.decontaminate(d, items),
        "decontaminate in blocks": lambda d: decontaminate.decontaminate(d, items, block_bytes=60),
        "window_dedup": window_dedup.remove_repeats,
        "token_store": lambda d: token_store.token_store(d, path),
        "quality": lambda d: quality.classify(d, labels),
        "suffix_dedup": suffix_dedup.remove_repeats,
        "pii": pii.find_pii,
    }


@pytest.mark.parametrize("name", operators(None, None))
def test_a_row_for_each_row(docs, items, labels, name):
    run = operators(items, labels)[name]
    got = collections.Counter(r["doc_id"] for r in run(docs).collect())
    assert got == collections.Counter(i for i, _ in _rows()[0])
    assert run(docs.limit(0)).count() == 0
    assert run(docs.where("text is null").limit(1)).count() == 1


def test_values_of_edges(docs, items, labels):
    run = {name: collections.defaultdict(list) for name in operators(None, None)}
    for name, f in operators(items, labels).items():
        for r in f(docs).collect():
            run[name][r["doc_id"]].append(r)
    assert {r["fp"] for i in (1, 2, 3) for r in run["simhash"][i]} == {0} and {r["component_id"] for i in (1, 2, 3) for r in run["simhash"][i]} == {1}
    assert [r["component_id"] for r in run["simhash"][4]] == [4, 4]
    assert [r["licences"] for r in run["licences"][7]] == [["MIT"]] and run["licences"][1][0]["licences"] == []
    for name in ("decontaminate", "decontaminate in blocks"):
        hit = run[name]
        assert [r["items"] for r in hit[4]] == [["10"], ["10"]] and [[tuple(s) for s in r["spans"]] for r in hit[4]] == [[(5, 30)]] * 2
        assert sorted(len(r["items"]) for r in hit[None]) == [0, 1, 1] and hit[1][0]["n_words"] == 0
        assert [tuple(s) for s in hit[7][0]["spans"]] == [(30_005, 30_030)]
    # windows of an earlier document go; rows of one doc_id are not earlier than one another, a null id is the last
    gone = {i: sorted(r["n_removed"] for r in rs) for i, rs in run["window_dedup"].items()}
    assert gone[4] == [0, 0] and gone[6] == [0] and gone[7] == [30_060] and gone[None] == [0, 0, 60]
    spans = {i: sorted(r["n_removed"] for r in rs) for i, rs in run["suffix_dedup"].items()}
    assert spans[4] == [len(PASSAGE)] * 2 and spans[None] == [0, 0, len(PASSAGE)] and spans[1] == spans[2] == [0]
    assert [r["n_email"] for r in run["pii"][7]] == [1] and run["pii"][1][0]["spans"] == ""
    assert sum(r["n_tokens"] == 1 for rs in run["token_store"].values() for r in rs) == 4
    starts = sorted((r["start"], r["n_tokens"]) for rs in run["token_store"].values() for r in rs)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


def test_pieces_of_edges(docs):
    got = packing.pack(docs, encoding.tokenizer_path(), capacity=512).collect()
    assert collections.Counter(r["doc_id"] for r in got if r["piece"] == 0) == collections.Counter(i for i, _ in _rows()[0])
    assert {r["length"] for r in got if r["doc_id"] == 1} == {1}
    assert packing.pack(docs.limit(0), encoding.tokenizer_path()).count() == 0


def test_scores_keep_columns_of_any_name(docs, labels):
    model = quality.Model(None, None)
    scored = quality.score(docs, model)
    assert scored.columns[:-1] == docs.columns and scored.columns[-1] != "cotrained"
    assert {r["cotrained"] for r in scored.collect()} == {"?"}
    assert quality.kept(docs, labels).columns == docs.columns


def test_labels_that_conflict(spark):
    texts = [" ".join(f"{'bad%%%' if i % 2 else 'good'}{(i * k) % 37}" for k in range(30)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(5, texts[5])] * 3, "doc_id long, text string")
    once = [(i, 1 - i % 2, None) for i in range(300)]
    twice = [(i, 1, None) for i in range(1, 300, 2)]  # the least quality counts
    a, b = ({(r["doc_id"], r["keep"]) for r in quality.classify(docs, spark.createDataFrame(t, "doc_id long, quality int, toxic int")).collect()} for t in (once, once + twice))
    assert a == b and sum(not keep for _, keep in a) > 150


def test_groups_of_edges(docs):
    kept = similar.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect())
    assert ids == [1, 4, 6]  # texts without words are one group; near copies go to the smallest id
    assert [r["text"] for r in kept.where("doc_id is null").collect()] == ["short"]


def test_stages_with_clashing_columns(spark, docs, items, labels, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    items.drop("row").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, docs.limit(0), docs.where("doc_id is null")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, str(tmp_path))
            assert out.columns == docs.columns and out.count() <= table.count()
            assert {r[0] for r in out.select("bad_id").distinct().collect()} <= {"?"}
        corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path)).count()
    clean = corpus_pipeline.clean(spark, docs, str(tmp_path))
    assert sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in clean.select("doc_id", "text").collect()) == sorted((i or 0, len(t or "")) for i, t in _rows()[0] if not t or PASSAGE not in t and t != "short")
    masked = corpus_pipeline.mask(spark, docs, str(tmp_path)).where("doc_id = 7").first()
    assert masked["text"].endswith("mail me at <email>") and masked["n_chars"] == len(masked["text"])
    assert corpus_pipeline.mask(spark, docs, str(tmp_path)).where(F.col("text").isNull() & F.col("n_chars").isNotNull()).count() == 0
