"""Queries that leave nothing out, against brute force on small tables."""

from __future__ import annotations

import math
from collections import Counter

import pytest

from varnaflow.plans import catalog


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _bleu1(p, t):
    if not p or not t:
        return 0.0
    logs = []
    for n in range(1, 5):
        a, b = (Counter(x[i : i + n] for i in range(len(x) - n + 1)) for x in (p, t))
        hits = sum((a & b).values())
        if n == 1 and not hits:
            return 0.0
        logs.append(math.log((hits or 0.1) / max(1, sum(a.values()))))
    return min(1.0, math.exp(1 - len(t) / len(p))) * math.exp(sum(logs) / 4)


@pytest.fixture(scope="module")
def turns(spark, tmp_path_factory):
    """Turns with their differences past 300 characters, with over 94 different words, and with accents."""
    long = " ".join(f"word{i}" for i in range(120)) + " KATHMANDU Xoro {{{"
    rows = [(1, 0, "user", long), (1, 1, "bot", "Tyo café ramro cha kaffé"), (2, 0, "user", "Straße " * 60 + "[END]"), (2, 1, "bot", "aaaa bb")]
    path = str(tmp_path_factory.mktemp("turns"))
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


def test_scores_of_whole_texts(spark, turns):
    pairs = {r["n"]: r for r in catalog._eval_pairs(spark, turns).collect()}
    assert sorted(pairs) == [1000, 1001, 2000, 2001] and len(pairs[1000]["ref"]) > 800
    got = catalog.queries()
    chars = {r["n"]: r for r in got["character_errors"](spark, turns).collect()}
    ws = {r["n"]: r for r in got["word_errors_of_pairs"](spark, turns).collect()}
    bleu = {r["n"]: r for r in got["bleu_scores"](spark, turns).collect()}
    assert set(chars) == set(ws) == set(bleu) == set(pairs)
    errors, sizes, roles = Counter(), Counter(), Counter()
    for n, r in pairs.items():
        h, t = r["hyp"], r["ref"]
        assert chars[n]["errors"] == _distance(h, t)
        assert chars[n]["cer"] == pytest.approx(_distance(h, t) / len(t), abs=1e-8)
        assert ws[n]["errors"] == _distance(h.split(), t.split())
        assert ws[n]["in_place"] == sum(a == b for a, b in zip(h.split(), t.split(), strict=False))
        assert bleu[n]["bleu1"] == pytest.approx(_bleu1(h, t), abs=1e-8)
        errors[r["role"]] += _distance(h, t)
        sizes[r["role"]] += len(t)
        roles[r["role"]] += 1
    for r in got["micro_scores"](spark, turns).collect():
        assert r["cer"] == pytest.approx(errors[r["role"]] / sizes[r["role"]], abs=1e-8)
        assert r["mean_edit_distance"] == pytest.approx(errors[r["role"]] / roles[r["role"]], abs=1e-8)


def test_one_score_alone(spark, turns):
    """A Python function of a column that is read nowhere else, and whose expression has lambdas in lambdas."""
    pairs = catalog._eval_pairs(spark, turns)
    whole = {r["role"]: r["cer"] for r in catalog.aggregates.micro_scores(pairs, "role").collect()}
    assert {r["role"]: r["cer"] for r in catalog.aggregates.micro_scores(pairs, "role").select("role", "cer").collect()} == whole
    rows = {r["n"]: r for r in pairs.collect()}
    assert {r["n"]: r["errors"] for r in catalog.character_errors(spark, turns).select("n", "errors").collect()} == {n: _distance(r["hyp"], r["ref"]) for n, r in rows.items()}


@pytest.fixture(scope="module")
def documents(spark, turns):
    text = "caffé caffe kaffé über uber\nराम राम\nthird line\nfourth line. It is\nfifth"
    spark.createDataFrame([(1, text, "fr", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{turns}/documents.parquet")
    return turns


def test_no_word_turn_or_line_is_left_out(spark, documents):
    run = lambda name: catalog.queries()[name](spark, documents).collect()
    every = {"caffé", "caffe", "kaffé", "über", "uber", "राम", "third", "line", "fourth", "fifth"}
    assert {r["word"]: r["n"] for r in run("unknown_words")} == {w: 2 if w in ("राम", "line") else 1 for w in every}
    assert {r["word"] for r in run("phonetic_code")} == every | {"it", "is"}
    code = {r["word"]: r["code"] for r in run("phonetic_code")}
    blocks = {}
    for w in every:
        if code[w]:
            blocks.setdefault(code[w], set()).add(w)
    blocks = {c: ws for c, ws in blocks.items() if len(ws) > 1}
    assert any(not w.isascii() for ws in blocks.values() for w in ws)
    assert {r["code"]: set(r["variants"].split()) for r in run("variant_dictionary")} == blocks
    assert {r["head"] for r in run("similar_codes")} | {r["head"] for r in run("block_pairs")} <= {min(ws) for ws in blocks.values()}
    assert {(r["doc_id"], r["line_no"]) for r in run("numbered_answers")} == {(1, i) for i in range(5)}
    ruled = {(r["conv_id"], r["turn"]): r["normalized"] for r in run("rule_based_turns")}
    assert len(ruled) == 4 and ruled[(1, 1)].startswith("tyo cafe ")
    assert {(r["conv_id"], r["turn"]) for r in run("normalized_turns")} == set(ruled)
    served = {(r["conv_id"], r["turn"]) for r in run("served_turns")}
    assert served == set(ruled)
