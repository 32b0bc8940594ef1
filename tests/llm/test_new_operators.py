"""Conversation repair, vector codes and the source mix against brute-force versions, with edge cases."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from varnaflow.llm import conversations, embeddings, mixing, queries, vector_codes

SF = "/root/testdata/sf0.001"

# Conversations ---------------------------------------------------------------


def _faults(rows):
    """rows: (turn, role, text) in order -> faults and counts, as the contract words them."""
    kinds, seen = [], set()
    for _, role, text in rows:
        black = re.findall(r"[^\x20\x09-\x0D]", text)
        kinds.append("blank" if not black else "duplicate" if (role, text) in seen else "" if black[-1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return kinds, (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal)


def _every_repair(rows, kinds, most):
    """The least (cost, audit, turns) of all edit sequences that cost at most ``most`` and obey the grammar: no dynamic programming."""
    best = None

    def go(i, cost, audit, made):
        nonlocal best
        if cost > most or best and cost > best[0] or not re.fullmatch(r"(s?(ua)*u?)?", "".join(r[:1] for r, _ in made)):
            return
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] for r, _ in made)) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, made)
        for role in ("user", "assistant"):
            go(i, cost + 5, audit + "I", [*made, (role, "")])
        if i < len(rows):
            _, role, text = rows[i]
            go(i + 1, cost + 2, audit + "D", made)
            if kinds[i] not in ("blank", "duplicate"):
                more = 5 * (kinds[i] == "truncated")
                go(i + 1, cost + more, audit + "K", [*made, (role, text)])
                for other in ("user", "assistant"):
                    go(i + 1, cost + 1 + more, audit + "R", [*made, (other, text)])

    go(0, 0, "", [])
    return best


def _sha(turns):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()


def _random_conversations(n, longest, seed):
    rnd = random.Random(seed)
    for c in range(n):
        for t in range(rnd.randint(0, longest)):
            yield c, rnd.choice([t, t + 1, None]), rnd.choice(["system", "user", "user", "assistant", "assistant", "tool", "ux"]), rnd.choice(["", " \t", "Hi.", "Yes!", f"Text {t}?", f"cut {t}", "cut"])


def _in_order(rows):
    return sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2], x[3]))


@pytest.mark.parametrize("piece", [1024, 3, 1])
def test_repairs_are_the_cheapest(spark, piece):
    """Against all edit sequences; with pieces of a turn or three, conversations cross pieces and ranges."""
    rows = list(_random_conversations(60, 5, 3))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r["conv_id"]: r for r in conversations.report(conversations.repair(frame, piece_turns=piece)).collect()}
    by = collections.defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = [x[1:] for x in _in_order(turns)]
        kinds, counts = _faults(turns)
        cost, audit, made = _every_repair(turns, kinds, 2 * len(turns))
        r = got[c]
        assert (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"]) == counts, c
        assert (r["cost"], r["audit"], r["repaired_sha256"]) == (cost, audit, _sha(made)), (c, turns)


def _by_layers(kinds, roles):
    """The least (cost, audit) by a plain search over (turn, state), for conversations too long for all sequences."""
    allowed = {"": "su", "s": "u", "u": "a", "a": "u"}
    layer = {"": (0, "")}

    def closed(layer):
        while True:
            more = dict(layer)
            for state, (cost, audit) in layer.items():
                for to in allowed[state].replace("s", ""):
                    more[to] = min(more.get(to, (math.inf, "")), (cost + 5, audit + "I"))
            if more == layer:
                return layer
            layer = more

    layer = closed(layer)
    for kind, role in zip(kinds, roles, strict=True):
        after = {}
        for state, (cost, audit) in layer.items():
            options = [(state, cost + 2, "D")]
            if kind not in ("blank", "duplicate"):
                more = 5 * (kind == "truncated")
                options += [(to, cost + more + (role[:1] != to), "R" if role[:1] != to else "K") for to in allowed[state] if to != "s" or role[:1] == "s"]
                options += [(to, cost + more + 1, "R") for to in allowed[state].replace("s", "")]
            for to, c, letter in options:
                after[to] = min(after.get(to, (math.inf, "")), (c, audit + letter))
        layer = closed(after)
    return min(layer[s] for s in ("", "a") if s in layer)


def test_long_conversation_is_cut(spark):
    """A conversation that holds most rows, over many pieces and ranges: same report as in one piece."""
    rnd = random.Random(5)
    rows = [(7, t // 2 if t % 11 else None, rnd.choice(["user", "assistant", "system", "tool"]), rnd.choice([f"Say {t}.", f"cut {t}", "Same.", ""])) for t in range(3000)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}.") for c in (1, 9, None) for t in range(4)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    fixed = conversations.repair(frame, piece_turns=64)
    assert fixed.where("conv_id = 7").count() > 40
    got = {r["conv_id"]: r for r in conversations.report(fixed).collect()}
    for c in (7, 1, None):
        turns = [x[1:] for x in _in_order([r for r in rows if r[0] == c])]
        kinds, counts = _faults(turns)
        r = got[c]
        assert (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"]) == counts
        assert (r["cost"], r["audit"]) == _by_layers(kinds, [x[1] for x in turns])
        _, made = conversations._apply(r["audit"], 0, [x[1] for x in turns], [x[2] for x in turns])
        assert re.fullmatch(r"(s?(ua)+)?", "".join(x[0] for x, _ in made)) and r["repaired_sha256"] == _sha(made)


def test_repeated_turns_of_one_conversation(spark):
    """Equal rows are spread over ranges and still all but the first are duplicates."""
    frame = spark.range(4000).select(F.lit(1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("Hi.").alias("text"))
    r = conversations.report(conversations.repair(frame)).first()
    assert (r["duplicate"], r["cost"], r["illegal"]) == (3999, 2 + 2 * 3999, 3999) and r["audit"] == "D" * 4000


def test_conversation_query(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    by, ids = collections.defaultdict(list), {r["conv_id"] for r in turns}
    for conv, turn, role, text in map(tuple, turns):
        fault = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        by[conv] += [(conv, turn, "user" if fault == 4 else role, text)] * (1 + (fault == 3))
    got = {r["conv_id"]: r for r in queries.op11_conversation_repair(spark, SF).collect()}
    assert set(got) == ids
    for c in ids:
        rows = [x[1:] for x in _in_order(by[c])]
        kinds, counts = _faults(rows)
        r = got[c]
        assert (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"]) == counts
        assert (r["cost"], r["audit"]) == _by_layers(kinds, [x[1] for x in rows])
        assert r["repaired_sha256"] == _sha(conversations._apply(r["audit"], 0, [x[1] for x in rows], [x[2] for x in rows])[1])


def test_conversation_edges(spark):
    names = "conv_id long, turn long, role string, text string, conv_key string, segment string, _part string, state string, present boolean"
    rows = [(1, None, None, None), (2, 0, "user", "x " * 400_000 + "."), (2, 1, "assistant", "ok."), (None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (3, 0, "user", "Hi.")]
    frame = spark.createDataFrame([(*r, "?", "?", "?", "?", r[0] != 3) for r in rows], names)
    got = {r["conv_id"]: r for r in conversations.report(conversations.repair(frame, F.col("present"))).collect()}
    assert (got[1]["blank"], got[1]["audit"], got[1]["cost"]) == (1, "D", 2)
    assert got[2]["audit"] == got[None]["audit"] == "KK"
    assert (got[3]["audit"], got[3]["cost"], got[3]["repaired_sha256"]) == ("", 0, hashlib.sha256(b"").hexdigest())
    assert conversations.report(conversations.repair(frame.limit(0))).count() == 0
    assert conversations.damaged(frame).where("conv_id = 1 and text = ' '").count() <= 2


# Vector codes ----------------------------------------------------------------


def _lloyd(rows, parts, entries, rounds):
    """rows: (id, whole numbers); plain Lloyd with full sums each round."""
    rows = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    w = len(rows[0][1]) // parts
    cut = [[q[p * w : (p + 1) * w] for p in range(parts)] for _, q in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            of = collections.defaultdict(list)
            for c in cut:
                of[near(c[p], books[p])[1]].append(c[p])
            books[p] = [[math.floor(Fraction(sum(x), len(of[e]))) for x in zip(*of[e], strict=True)] if e in of else c for e, c in enumerate(books[p])]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    return collections.Counter((i, tuple(e for _, e in f), sum(d for d, _ in f)) for (i, _), f in zip(rows, found, strict=True)), books


@pytest.mark.parametrize("magnitude", [1.0, 3000.0])
def test_codes_equal_plain_lloyd(spark, magnitude):
    rnd = random.Random(2)
    vectors = [(i if i % 17 else None, [rnd.choice([rnd.gauss(0, magnitude), -0.5, 0.25]) for _ in range(8)]) for i in range(150)]
    vectors += [(5, vectors[9][1]), (5, vectors[9][1])]  # an id that repeats, equal rows
    bad = [(1, None), (2, [0.0] * 7 + [None]), (3, [0.0] * 7 + [math.nan]), (4, [math.inf] + [0.0] * 7)]
    frame = spark.createDataFrame([(i, v, "?", "?", "?", "?") for i, v in vectors + bad], "vec_id long, embedding array<double>, code string, q string, kind string, label string").repartition(4)
    codes = vector_codes.compress(frame, parts=2, entries=16, scale=64, rounds=3)
    got = collections.Counter((r["vec_id"], tuple(vector_codes.code_bytes(r["code"])), r["error"]) for r in codes.table.collect())
    want, books = _lloyd([(i, [math.floor(64 * x) for x in v]) for i, v in vectors], 2, 16, 3)
    assert codes.codebooks.tolist() == books and got == want
    assert codes.changed[0] == 2 * len(vectors) and codes.changed[1] < codes.changed[0]
    restored = {r["vec_id"]: r["vector"] for r in vector_codes.decompressed(codes).collect()}
    assert len(restored[7]) == 8 and all(len(r["vector"]) == 8 for r in vector_codes.decompressed(codes).collect())


def test_code_edges(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0], 1), (2, [1.0, 2.0, 3.0, 4.0], None), (3, [1.0, 2.0, 3.0, 4.0], None)], "vec_id long, embedding array<float>, label int")
    codes = vector_codes.compress(frame)
    assert codes.codebooks.shape == (4, 3, 1) and {bytes(r["code"]) for r in codes.table.collect()} == {bytes(8)}
    assert {r["label_error"] for r in vector_codes.label_errors(codes.table).collect()} == {0}
    none = vector_codes.compress(frame.where("vec_id < 0"))
    assert none.table.count() == 0 and none.codebooks.size == 0
    with pytest.raises(ValueError, match="cut"):
        vector_codes.compress(frame, parts=3)
    assert np.array_equal(vector_codes.nearest(np.array([[5], [1 << 27]]), np.array([[0], [1 << 26]]))[0], [0, 1])


# Mixing ----------------------------------------------------------------------


def _targets(sizes, weights=(5, 2, 1)):
    """sizes: source -> words; exact resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = Fraction(3 * sum(sizes.values()), 2), set()
    while True:
        rest = [s for s in names if s not in full]
        level = (total - sum(2 * sizes[s] for s in full)) / (sum(w[s] for s in rest) or 1)
        over = {s for s in rest if level * w[s] > 2 * sizes[s]}
        if not over:
            return {s: float(2 * sizes[s] if s in full else level * w[s]) for s in names}
        full |= over


def test_mix_meets_its_targets(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(900):
        source = rnd.choice(["big", "big", "big", "ä", "z", "a", "", None, "tiny" if i % 200 == 0 else "big"])
        rows.append((i if i % 50 else None, " ".join(["w"] * rnd.choice([0, 1, 5, 30, 400])) or rnd.choice(["", None, " \t"]), source))
    rows += [(3, "same row", "z")] * 3 + [(5000, "long " * 30_000, "a"), (5001, None, "empty")]
    names = "doc_id long, text string, source string, row string, slot string, size string, ord string"
    docs = spark.createDataFrame([(*r, "?", "?", "?", "?") for r in rows], names).repartition(5)
    got = mixing.mixed(docs, block=128).collect()
    assert collections.Counter((r["doc_id"], r["source"]) for r in got) == collections.Counter((i, s) for i, _, s in rows)
    sizes, taken = collections.Counter(), collections.Counter()
    for i, t, s in rows:
        sizes[s] += len((t or "").split())
    for r in got:
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
    want = _targets(sizes)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5
    again = mixing.mixed(docs.repartition(2), block=128).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert mixing.mixed(docs.limit(0)).count() == 0
    assert {r["taken"] for r in mixing.mixed(docs.where("text is null")).collect()} == {0}


def test_schedule_ranks_and_spreads(spark):
    """Ranks equal counting one by one; every stretch of slots has all sources in nearly their shares."""
    wanted = {"a": 600, "b": 37, "c": 1, None: 250, "e": 0, "f": 136}
    sources = spark.createDataFrame([(s, i + 1, n) for i, (s, n) in enumerate(wanted.items())], "source string, ord long, slots long")
    rows = sorted((r["slot"], r["source"] or "", r["rank"]) for r in mixing.schedule(sources, 10).collect())
    whole, count = sum(wanted.values()), collections.Counter()
    assert len(rows) == whole
    for slot, s, rank in rows:
        assert rank == count[s]
        count[s] += 1
        if slot < whole and slot % 50 == 0:
            assert all(abs(count[s or ""] - n * slot / whole) <= math.log2(whole) + 1 for s, n in wanted.items())
    assert count == collections.Counter({s or "": n for s, n in wanted.items() if n})


def test_mix_covers_each_word_once_a_round(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 40), "s" if i % 3 else "t") for i in range(300)], "doc_id long, text string, source string")
    sizes = docs.select("doc_id", "source", mixing.words_in(F.col("text")).alias("size"), F.col("doc_id").alias("row"))
    sources = mixing.targets(sizes)
    parts = mixing.mix(sizes, sources, block=64).collect()
    times = collections.defaultdict(collections.Counter)
    for r in parts:
        times[r["doc_id"]].update(range(r["start"], r["start"] + r["length"]))
    for r in sizes.where("size > 0").collect():
        counts = times[r["doc_id"]]
        assert set(counts) <= set(range(r["size"])) and max(counts.values(), default=0) - min((counts[k] for k in range(r["size"])), default=0) <= 1
    per_slot = collections.Counter()
    for r in parts:
        per_slot[r["slot"]] += r["length"]
    assert max(per_slot.values()) == 64 and sum(n < 64 for n in per_slot.values()) <= 2


# Forest ----------------------------------------------------------------------


def _links_of(x, cosine=0.98, block=512):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.concatenate([(unit[i : i + block] @ unit.T >= cosine).sum(1) - 1 for i in range(0, len(x), block)])


def test_forest_with_depth_and_clashing_names(spark):
    """One label of 6,000 vectors, production parameters: trees have depth, and every link of 0.98 to 0.985 between different vectors is looked for."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.standard_normal((2000, 64))
    noise -= (noise * x[:2000]).sum(1, keepdims=True) * x[:2000]
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    angle = np.arccos(rng.uniform(0.98, 0.985, (2000, 1)))
    rows = np.concatenate([x, np.cos(angle) * x[:2000] + np.sin(angle) * noise])
    names = "vec_id long, embedding array<double>, label int, key string, keys string, size string, block string, rep string, vector string"
    frame = spark.createDataFrame([(i, v.tolist(), 3, *["?"] * 6) for i, v in enumerate(rows)], names).repartition(4)
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(frame).collect()}
    want = _links_of(rows)
    assert len(got) == 6000 and all(got[i]["n_links"] <= want[i] for i in got)
    assert embeddings.Forest.fit(rows[:3000].tolist(), 6000, 6, 256, 0.98, 0.5).keys(rows[:1].tolist())[0] is not None
    assert sum(r["n_links"] for r in got.values()) >= 0.98 * want.sum() > 3900
    linked = [i for i in range(4000, 6000) if got[i]["n_links"]]
    assert all(got[i]["component_id"] <= i - 4000 for i in linked)
