"""Each operator against a brute-force version, with nulls, empty and repeated rows, and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from varnaflow.llm import decontaminate, embeddings, encoding, graph, licences, packing, pii, quality, similar, simhash, suffix, suffix_dedup, superkmer, token_store, window_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, rep string, keys string"


def _docs(spark, texts, ids=None):
    """Documents with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i if ids is None else ids[i], t, "en", "s", None if t is None else len(t), "r", "p", "k") for i, t in enumerate(texts)], SCHEMA)


def _find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(300)]
    line = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    shared = line(40)
    out = [None, "", " \n\t", "one", "one", shared, "x " + shared + " y", line(15) + "  " + shared, "a " * 60, "long " * 3000 + shared]
    out += [line(rnd.randint(1, 60)) for _ in range(60)]
    return out + out[20:35] + [out[40] + " tail", None]


def test_simhash(spark, texts):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(_docs(spark, texts)).collect()}

    def print_of(t):
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [print_of(t) for t in texts]
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = _find(parent, i), _find(parent, j)
                parent[max(a, b)] = min(a, b)
    for i, p in enumerate(prints):
        assert got[i]["fp"] % (1 << 64) == p
        assert got[i]["component_id"] == _find(parent, i)
    assert simhash.near_duplicates(_docs(spark, [])).count() == 0
    same = simhash.near_duplicates(_docs(spark, ["a b", "a b", "a b"], [None, 3, 3])).collect()
    assert [r["component_id"] for r in same] == [3, 3, 3]


@pytest.mark.parametrize("dense", [8, 10**6])
def test_dense_buckets_link_the_same(spark, dense):
    rnd = random.Random(2)
    base, prints = rnd.getrandbits(64), set()
    while len(prints) < 250:
        x = rnd.choice([base, *prints]) if rnd.random() < 0.5 else base
        for _ in range(rnd.randint(0, 3)):
            x ^= 1 << rnd.randrange(64)
        prints.add(x)
    f = np.array(sorted(prints), np.uint64)
    parent = list(range(len(f)))
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[:i] ^ f[i]) <= 2).tolist():
            a, b = _find(parent, i), _find(parent, j)
            parent[max(a, b)] = min(a, b)
    frame = spark.createDataFrame([(int(x), i) for i, x in enumerate(f.view(np.int64))], "fp long, rep long")
    got = {r["node"]: r["component"] for r in graph.components(simhash.links(frame, 2, dense=dense)).collect()}
    assert all(got.get(i, i) == _find(parent, i) for i in range(len(f)))


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (None, 3)], "u long, v long")
    got = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_components_take_no_step_beyond_stars(spark, monkeypatch):
    """Links that come as stars are written once; what a step has made stars is not gone through again."""
    written = []
    monkeypatch.setattr(graph, "stored", lambda df, name, real=graph.stored: written.append(name) or real(df, name))
    edges = lambda pairs: {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert edges([(1, 2), (1, 3), (9, 7), (3, 1), (5, 5), (None, 4)]) == {1: 1, 2: 1, 3: 1, 7: 7, 9: 7}
    assert len(written) == 1
    assert edges([(1, 2), (2, 3), (3, 4), (8, 9), (7, 9)]) == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7}
    assert edges([]) == {}


def test_licences(spark):
    mit = 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including the rights to use, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED.'
    rows = [mit, "text.\nLicensed under the Apache License, Version 2.0.", "Released under the MIT License.\nLicensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "See the GNU General Public License for more details.", None, "", "licence to drive"]
    got = [(r["licences"], r["unexplained"]) for r in licences.scan_licences(_docs(spark, rows)).orderBy("doc_id").collect()]
    assert got == [(["MIT"], []), (["Apache-2.0"], []), (["MIT", "CC-BY-NC"], []), (["GPL-3.0"], []), ([], ["GplSee"]), ([], []), ([], []), ([], [])]


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_decontamination(spark, block_bytes):
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcé1") for _ in range(3)) for _ in range(40)]
    line = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [line(25), line(12), "Zebra quagga", "zebra", "", None, line(10), line(25)]
    items[7] = items[0]
    docs = [line(30) + " " + (items[k] or "").upper().replace("É", "é").replace(" ", ", ") + " " + line(5) for k in (0, 1, 2, 3, 6)] + [None, "", line(200), " ".join((items[0] or "").split()[3:14]), "zebra zebra"]
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)] + [(None, line(12), "x")], "item_id long, text string, doc_id string")
    hits = decontaminate.decontaminate(_docs(spark, docs), table, block_bytes=block_bytes)
    got = {r["doc_id"]: r for r in decontaminate.report(hits).collect()}
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for i, t in enumerate(items):
        w = cut(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(i)
    for i, t in enumerate(docs):
        w, hit, found = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        assert tuple(got[i]) == (i, len(w), len(hit), len(found), digest, bool(hit))
    assert decontaminate.decontaminate(_docs(spark, docs), table.limit(0)).where(F.size("spans") > 0).count() == 0


def test_window_dedup(spark, texts):
    ids = [None if i == 30 else i for i in range(len(texts))]
    got = collections.defaultdict(list)
    for r in window_dedup.remove_repeats(_docs(spark, texts, ids), chunk_bytes=4000, bucket_bytes=2000).collect():
        got[r["doc_id"]].append(r)
    order = lambda i: 10**9 if ids[i] is None else i
    first = {}
    cut = [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]
    for i, w in enumerate(cut):
        for j in range(len(w) - 12):
            key = tuple(w[j : j + 13])
            first[key] = min(first.get(key, 10**9), order(i))
    for i, w in enumerate(cut):
        gone = {j + d for j in range(len(w) - 12) if first[tuple(w[j : j + 13])] < order(i) for d in range(13)}
        (r,) = got[ids[i]]
        assert (r["n_words"], r["n_removed"], r["kept"]) == (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))


def _byte_repeats(rows, window):
    seen = collections.Counter(t[j : j + window] for t in rows for j in range(len(t) - window + 1))
    for t in rows:
        gone = np.zeros(len(t) + 1, int)
        for j in range(len(t) - window + 1):
            if seen[t[j : j + window]] > 1:
                gone[j] += 1
                gone[j + window] -= 1
        yield np.cumsum(gone)[:-1] > 0


def test_suffix_dedup(spark, texts):
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(_docs(spark, texts), chunk_bytes=4000, bucket_bytes=2000).collect()}
    rows = [(t or "").encode() for t in texts]
    for i, (t, gone) in enumerate(zip(rows, _byte_repeats(rows, 200), strict=True)):
        kept = bytes(np.frombuffer(t, np.uint8)[~gone]) if len(t) else b""
        assert (got[i]["n_bytes"], got[i]["n_removed"], bytes(got[i]["kept"])) == (len(t), int(gone.sum()), kept)
        assert len(got[i]["spans"]) == int((np.diff(gone.astype(int), prepend=0) == 1).sum())


@pytest.mark.parametrize(("shard", "at_once"), [(1 << 30, 10**9), (200, 2)])
def test_large_groups_are_cut_again(monkeypatch, shard, at_once):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    monkeypatch.setattr(window_dedup, "AT_ONCE", at_once)
    rnd = random.Random(5)

    def run(kind, solve, docs):
        chunk, bucket, spans = superkmer.Chunk(kind, 1, 0), superkmer.Bucket(kind, solve), collections.defaultdict(list)
        for i, t in enumerate(docs):
            for first, part in kind.segments(t):
                chunk.add(i, 0, first, part)
        for _, step, number, blob in sorted(chunk.rows(), key=lambda r: r[:3]):
            if step < 2:
                (bucket.minimisers, bucket.strings)[step](number, blob)
            else:
                for d, _, s, e in bucket.occurrences(number, blob):
                    spans[d].append({"start": s, "end": e})
        return [superkmer.united(spans[i]) for i in range(len(docs))]

    for _ in range(15):
        parts = ["".join(rnd.choice("ab c") for _ in range(rnd.randint(5, 80))) for _ in range(4)]
        docs = ["".join(rnd.choice([*parts, "a" * rnd.randint(0, 50), "xy " * 9]) for _ in range(rnd.randint(0, 6))).encode() for _ in range(30)]
        got = run(superkmer.Kind(False, 20, 6), suffix_dedup.repeated_windows, docs)
        for spans, gone in zip(got, _byte_repeats(docs, 20), strict=True):
            edge = np.flatnonzero(np.diff(gone.astype(int), prepend=0, append=0)).tolist()
            assert spans == list(zip(edge[::2], edge[1::2], strict=True))


@pytest.mark.parametrize("places", [0.5, 100])
def test_suffix_arrays(monkeypatch, places):
    monkeypatch.setattr(suffix, "PLACES", places)
    rng = np.random.default_rng(1)
    for trial in range(150):
        t = np.append(rng.integers(1, rng.choice([2, 3, 9, 200]), rng.integers(1, 60)), 0)
        if trial % 5 == 0:
            t = np.append(np.tile(rng.integers(1, 3, 3), 15), 0)
        sa = suffix.suffix_array(t)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        common = suffix.permuted_lcp(t, sa, np.full(len(t), len(t)))
        for a, b in zip(sa[:-1].tolist(), sa[1:].tolist(), strict=True):
            n = 0
            while max(a, b) + n < len(t) and t[a + n] == t[b + n]:
                n += 1
            assert common[b] == n


def test_large_shards_are_sorted_by_induction_alone(monkeypatch):
    rnd = random.Random(12)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    text = " ".join(rnd.choice(words) for _ in range(40_000)).encode()[: 200 << 10]
    t, levels = np.append(np.frombuffer(text, np.uint8).astype(np.int64), 0), []
    plain = suffix.suffix_array

    def seen(t):
        levels.append(len(t))
        return plain(t)

    monkeypatch.setattr(suffix, "suffix_array", seen)
    sa = suffix.suffix_array(t)
    assert len(levels) >= 3 and all(2 * b <= a + 1 for a, b in zip(levels[:-1], levels[1:], strict=True))  # reduced strings, again and again
    order = sa.tolist()
    assert sorted(order) == list(range(len(t)))
    data = text + b"\0"
    assert all(data[a : a + 400] <= data[b : b + 400] for a, b in zip(order[:-1], order[1:], strict=True))


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((30, 16))
    rows = [(i, v.tolist(), int(k % 3)) for i, (k, v) in enumerate((k, base[k] + rng.standard_normal(16) * s) for k in range(30) for s in (0, 0, 0.02, 0.05, 0.3))]
    rows += [(1000, [0.0] * 16, 1), (1001, None, 1), (1002, [None] * 16, 1), (1003, [float("nan")] * 16, 1), (1004, base[0].tolist(), None), (1005, base[0].tolist()[:8], 0)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, rep string")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(frame, leaf=8, block=16).collect()}
    parent, links = {r[0]: r[0] for r in rows}, collections.Counter()
    for i, v, a in rows:
        for j, w, b in rows:
            if i < j and a is not None and a == b and i < 1000 and j < 1000:
                x, y = np.array(v), np.array(w)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    links[i] += 1
                    links[j] += 1
                    p, q = _find(parent, i), _find(parent, j)
                    parent[max(p, q)] = min(p, q)
    found = sum(r["n_links"] for r in got.values())
    assert found >= 0.9 * sum(links.values())
    assert all(got[i]["n_links"] <= links[i] for i in got)
    if found == sum(links.values()):
        assert all(got[i]["component_id"] == _find(parent, i) and got[i]["kept"] == (_find(parent, i) == i) for i in got)
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(1000, 1006))
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


def test_leaves_stay_small_however_small_the_sample(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((6000, 12))
    x[:300] = x[0] + rng.standard_normal((300, 12)) * 0.01  # a family that no split parts
    near = x[1000:1400] + rng.standard_normal((400, 12)) * 0.02
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([x, near]))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(frame, sample=20, leaf=64, large=128).collect()}
    unit = np.concatenate([x, near])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    assert sum(got.values()) >= 0.95 * links.sum() and all(got[i] <= n for i, n in enumerate(links.tolist()))
    members = spark.createDataFrame([(i, 1, 1, v, 12, k) for i, v, _ in rows for k in (0, 1)], "rep long, copies long, label int, vector array<double>, size int, key long")
    split = embeddings.split_again(members, 0.5 * (2 - 2 * 0.98) ** 0.5, 128)
    sizes = sorted((r["count"] for r in split.groupBy("key").count().collect()), reverse=True)
    assert sizes[0] < 2600 and sum(n * n for n in sizes) < 2 * 6400**2 / 4
    assert split.select("rep").distinct().count() == 6400
    assert embeddings.split_again(members.where("rep < 60"), 0.1, 128) is None


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(encoding.tokenizer_path())


def _ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoding_equals_the_tokenizer(tokenizer):
    import pyarrow as pa

    rnd = random.Random(3)
    letters = list("aAbZ.,!?;:' \n\t\x0b\x85\xa00'9éÉßñİıΣςǰ̌́‍’“…😀ａＡ。我क़ँ्½²")
    rows = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 25))) for _ in range(1500)] + ["", "don't <|endoftext|> <|ENDOFTEXT|> x", "İ? क़.", "y" * 700 + "."]
    got = encoding.encoder(encoding.tokenizer_path()).encode_many(pa.array([*rows, None]))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [_ids(tokenizer, t) for t in [*rows, None]]


def test_token_store(spark, texts, tokenizer, tmp_path):
    manifest = token_store.write_shards(_docs(spark, texts), f"file://{tmp_path}/shards", encoding.tokenizer_path(), frame_ids=64)
    got = {r["doc_id"]: r for r in token_store.read_shards(manifest).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = np.array([*_ids(tokenizer, t), 2], "<u4")
        assert tuple(got[i]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    file = manifest.first()["file"]
    reader = token_store.ShardReader(file)
    wanted = int(reader.index(len(reader.firsts) - 1)["doc_id"][-1])
    assert reader.find(wanted) == [np.array([*_ids(tokenizer, texts[wanted]), 2], "<u4").tobytes()]
    path = file.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[10] ^= 255
    open(path, "wb").write(data)
    with pytest.raises(Exception):  # noqa: B017  a damaged frame never passes as data
        list(token_store.ShardReader(file).documents())
    assert token_store.read_shards(token_store.write_shards(_docs(spark, []), f"file://{tmp_path}/none", encoding.tokenizer_path())).count() == 0


def test_token_shards_are_bounded(spark, tmp_path):
    """Tiny bounds make many shards; starts stay without gaps, and a reader touches its own frames only."""
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice("alpha beta gamma delta".split()) for _ in range(rnd.randint(0, 60))) for _ in range(400)] + ["long word " * 3000]
    ids = [i // 2 for i in range(400)] + [None]
    manifest = token_store.write_shards(_docs(spark, texts, ids), f"file://{tmp_path}/shards", encoding.tokenizer_path(), frame_ids=32, shard_ids=500, shard_docs=12, index_docs=5)
    shards = manifest.orderBy("shard", "part").collect()
    assert len(shards) > 33 and max(r["n_docs"] for r in shards) == 12 and sum(r["n_docs"] for r in shards) == len(texts)
    assert max(r["n_tokens"] for r in shards if r["n_docs"] > 1) < 1000
    rows = sorted(token_store.read_shards(manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted(ids, key=lambda i: (i is not None, i))
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:], strict=False))
    file = next(r for r in shards if r["n_docs"] == 12)["file"]
    reader = token_store.ShardReader(file)
    opened = reader.read_frames
    wanted = next(i for i, _ in list(token_store.ShardReader(file).documents())[6:] if i is not None)
    found = reader.find(wanted)
    assert sorted(zlib.crc32(x) for x in found) and {zlib.crc32(x) for x in found} <= {r["ids_crc32"] for r in rows if r["doc_id"] == wanted}
    assert opened == 1 and reader.read_frames - opened <= 2 + 2 * len(found) * 3 < reader.n_frames + len(reader.firsts) + 12


def test_packing(spark, texts, tokenizer):
    rows = packing.pack(_docs(spark, texts), encoding.tokenizer_path(), capacity=128, group=40).collect()
    total, places, seen = 0, collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        ids = np.array([*_ids(tokenizer, texts[r["doc_id"]]), 0], "<u4")[r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(ids.tobytes()) == r["ids_crc32"]
        assert r["start"] == 128 * r["piece"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        seen[r["doc_id"]].append(r["length"])
        total += r["length"]
    assert total == sum(len(_ids(tokenizer, t)) + 1 for t in texts)
    assert all(n == 128 for s in seen.values() for n in sorted(s)[1:])
    for p in places.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= 128
    assert packing.pack(_docs(spark, []), encoding.tokenizer_path()).count() == 0


def _squared_fill(bins, lengths):
    return sum(sum(lengths[i] for i in b) ** 2 for b in bins.items)


def test_local_search_empties_bins(monkeypatch):
    rnd = random.Random(8)
    for low, high, capacity, n in ((600, 1100, 2048, 1500), (300, 800, 2048, 3000), (3, 30, 40, 200), (1, 3, 100, 50)):
        lengths = [rnd.randint(low, high) for _ in range(n)]
        bins = packing.Bins(lengths, capacity)
        bins.best_fit()
        before, squared = sum(map(bool, bins.items)), _squared_fill(bins, lengths)
        steps = bins.local_search()
        filled = [sum(lengths[i] for i in b) for b in bins.items if b]
        assert max(filled) <= capacity and len(filled) >= -(-sum(lengths) // capacity)
        assert sorted(i for b in bins.items for i in b) == list(range(n))
        assert [sum(lengths[i] for i in b) + f for b, f in zip(bins.items, bins.free, strict=True) if b] == [capacity] * len(filled)
        assert _squared_fill(bins, lengths) >= squared + 2 * steps  # every step raises it
        if n >= 1500:  # lengths of which few fill a sequence: best fit leaves room
            assert steps > 0 and len(filled) < before
        assert bins.fewest() or bins._pass() == 0  # no move is left
    bins = packing.Bins([6, 4, 5, 3, 5], 10)
    bins.items, bins.free = [[0], [1, 2], [3], [4]], [4, 1, 7, 5]
    bins.local_search()
    assert sum(map(bool, bins.items)) == 3


def _fewest_bins(lengths, capacity):
    """The optimum, by branch and bound over all placements."""
    lengths, best = sorted(lengths, reverse=True), len(lengths)

    def go(i, filled):
        nonlocal best
        if len(filled) >= best:
            return
        if i == len(lengths):
            best = len(filled)
            return
        for b in range(len(filled)):
            if filled[b] + lengths[i] <= capacity and filled[b] not in filled[:b]:
                go(i + 1, [*filled[:b], filled[b] + lengths[i], *filled[b + 1 :]])
        go(i + 1, [*filled, lengths[i]])

    go(0, [])
    return best


def test_bins_against_the_optimum():
    """Up to twelve pieces: where best fit misses the optimum, the search reaches it in most cases (79% of 1,267 in a longer run), and is never worse."""
    rnd, missed, reached = random.Random(1), 0, 0
    for _ in range(3000):
        capacity = rnd.choice([20, 50, 100])
        lengths = [rnd.randint(max(1, capacity // 8), capacity // 2) for _ in range(rnd.randint(6, 12))]
        bins = packing.Bins(lengths, capacity)
        bins.best_fit()
        before = sum(map(bool, bins.items))
        bins.local_search()
        after, fewest = sum(map(bool, bins.items)), _fewest_bins(lengths, capacity)
        assert fewest <= after <= min(before, fewest + 1)
        if before > fewest:
            missed += 1
            reached += after == fewest
    assert missed > 100 and reached > 0.7 * missed
    # best fit needs three bins; only an exchange finds the two
    assert len(set(packing.pack_lengths([10, 18, 25, 12, 11, 22], 50)[0])) == 2 == _fewest_bins([10, 18, 25, 12, 11, 22], 50)


def test_equal_rows_spread_over_groups(spark):
    docs = _docs(spark, ["one two three"] * 600, [7] * 300 + [None] * 300)
    rows = packing.pack(docs, encoding.tokenizer_path(), capacity=64, group=100).collect()
    assert len(rows) == 600
    by_group = collections.Counter(r["sequence_id"] >> 32 for r in rows)
    assert len(by_group) == 6 and max(by_group.values()) < 200


def test_pii(spark):
    base = "a@b.co, 1.2.3.4, 999.1.1.1, 4111 1111 1111 1111, +1 (555) 555-1234, 4111 1111 1111 1112"
    disguised = {
        "to john [at] example [dot] com now": ["email"],
        "john dot doe at example dot co dot uk": ["email"],
        "jоhn@exаmple.com": ["email"],
        "call plus one five five five one two three four five six seven": ["phone"],
        "ip one nine two dot one six eight dot one dot one!": ["ip"],
        "four one one one 1111 one one one one 1111": ["card"],
        "４１１１ １１１１ １１１１ １１１１": ["card"],
        "look at the dot on the map at noon": [],
        "write to john at example dot xyz please": ["email"],
        "john at mail dot example dot kr": ["email"],
        "meet us at a dot that is red": [],
        "we met at noon dot and left": [],
        "host 192[.]168[.]1[.]1 is up": ["ip"],
        "host 192[dot]168 (dot) 1.1 is up": ["ip"],
        "see [1] 2 (3) 4": [],
        "x" * 500 + " at example dot com": ["email"],
        "a1 (dot) b2 {dot} c3 [at] d4 . e5": [],
        "q.a1 (dot) b2 {dot} c3 [at] d4 (dot) e5": ["email"],
        "un deux trois quatre cinq six sept huit neuf": [],
    }
    rows = [base, None, "", *disguised, "1" * 30_000, "a" * 30_000 + "@", "+1" + " " * 30_000]
    got = {r["doc_id"]: r for r in pii.find_pii(_docs(spark, rows)).collect()}
    assert tuple(got[0][f"n_{k}"] for k in pii.KINDS) == (1, 1, 1, 1)
    assert got[1]["spans"] == got[2]["spans"] == ""
    for i, kinds in enumerate(disguised.values(), 3):
        assert [s.split(":")[0] for s in got[i]["spans"].split(",") if s] == kinds
        assert not set(filter(None, got[i]["base"].split(","))) - set(got[i]["spans"].split(","))
    kind, start, end = got[3]["spans"].split(":")
    assert rows[3][int(start) : int(end)] == "john [at] example [dot] com"
    for text, whole in (("x" * 500 + " at example dot com", "x" * 500 + " at example dot com"), ("q.a1 (dot) b2 {dot} c3 [at] d4 (dot) e5", "q.a1 (dot) b2 {dot} c3 [at] d4 (dot) e5"), ("host 192[dot]168 (dot) 1.1 is up", "192[dot]168 (dot) 1.1")):
        kind, start, end = got[rows.index(text)]["spans"].split(":")
        assert text[int(start) : int(end)] == whole
    masked = spark.createDataFrame([(base,), (None,)], "t string").select(pii.masked(F.col("t")).alias("m")).collect()
    assert masked[0]["m"].startswith("<email>, <ip>, 999.1.1.1, <card>, <phone>, 4")
    assert masked[1]["m"] is None


@pytest.mark.parametrize("unit", [" ", "\t", "\n", "(at)", "@ ", "one two ", "a(at)b.c ", " at ", "a at b dot c ", "a at the dot b ", "1(dot)", "( ", "x@y ", "a@b.co ", "+1 "])
def test_pii_scans_are_linear(unit):
    """A megabyte of what each pattern begins with takes seconds at most; squared growth took minutes to hours."""
    text = unit * (1_000_000 // len(unit)) + "mail me at joe at example dot com"
    began = time.perf_counter()
    base = pii.base_spans(text)
    spans = pii.added_spans(text, base)
    masked = pii.mask_text(text)
    assert time.perf_counter() - began < 40
    assert ("email", len(text) - 22, len(text)) in spans and masked.endswith("mail me at <email>")


def test_base_spans_equal_the_patterns():
    rnd = random.Random(9)
    patterns = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def luhn(s):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(s))) % 10 == 0

    for _ in range(1500):
        t = "".join(rnd.choice(["a", "@", ".", "1", "25", "+", " ", "-", "4111111111111111", "b.c", "é", "0"]) for _ in range(rnd.randint(0, 25)))
        want = []
        for kind, pattern in patterns:
            for m in re.finditer(pattern, t):
                digits = re.sub("[^0-9]", "", m[0])
                if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15:
                    continue
                want.append((kind, *m.span()))
        assert pii.base_spans(t) == want, t


def test_quality_learns_both_labels(spark):
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcdefg") for _ in range(4)) for _ in range(200)]
    rows, labels = [], []
    for i in range(900):
        low, bad = i % 5 == 0, i % 7 == 0
        w = [rnd.choice(words) + ("%%%" if low else "") for _ in range(30)]
        if bad:
            w[rnd.randrange(30)] = rnd.choice(["vile", "vilest", "nasty"])
        rows.append(" ".join(w))
        if i < 600:
            labels.append((i, int(not low), int(bad)))
    docs = _docs(spark, rows)
    table = spark.createDataFrame([*labels, (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(docs, table).collect()}
    right = sum(got[i]["keep"] == (i % 5 != 0 and i % 7 != 0) for i in range(600, 900))
    assert right >= 290
    assert set(quality.kept(docs, table).columns) == set(docs.columns)
    no_labels = quality.classify(docs, table.limit(0))
    assert no_labels.where("keep and p_quality is null and p_toxic is null").count() == 900
    assert quality.classify(_docs(spark, [None, ""]), table).count() == 2


def test_similar_documents(spark):
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(2000)]
    base = [[rnd.choice(words) for _ in range(200)] for _ in range(12)]
    near = [[*b[:100], "changed", *b[101:]] for b in base]
    rows = [" ".join(x) for x in base + near + base[:3]] + [None, "", " ", "short"]
    kept = {r["doc_id"] for r in similar.keep_one(_docs(spark, rows)).collect()}
    assert kept >= {*range(12), 27, 30}  # empty texts are one group, white space has no words either
    assert not kept & set(range(12, 27))
    twice = similar.keep_one(_docs(spark, ["a b", "a b", "c"], [7, 7, None]))
    assert twice.count() == 2
    assert twice.columns == _docs(spark, []).columns
    assert similar.keep_one(_docs(spark, [])).count() == 0


def test_similar_documents_are_those_of_the_exact_similarity(spark):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(5000)]
    rows = []
    for i in range(150):
        a = [rnd.choice(words) for _ in range(94 if i % 2 else 274)]
        n = len(a) - 4
        b, lost = list(a), round(n * rnd.uniform(0.08, 0.16))  # similarities about 0.8
        b[-lost:] = [rnd.choice(words) for _ in range(lost)]
        rows += [" ".join(a), " ".join(b)]
    for _ in range(40):  # one shingle shared 60 times, few others
        same = "a " * 64
        rows += [same + " ".join(rnd.choice(words) for _ in range(8)) for _ in range(2)]

    def of(text):
        w = text.split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    pairs = [(of(a), of(b)) for a, b in zip(rows[::2], rows[1::2], strict=True)]
    alike = [5 * len(a & b) >= 4 * len(a | b) for a, b in pairs]
    assert 40 < sum(alike[:150]) < 110
    kept = {r["doc_id"] for r in similar.keep_one(_docs(spark, rows)).collect()}
    for i in range(150):
        assert (2 * i in kept) and (2 * i + 1 in kept) != alike[i]
    # blocks give the same links as one block
    texts = spark.createDataFrame([(i, 0, t) for i, t in enumerate(rows[:60])], "rep long, component long, text string")
    links = {frozenset((r["u"], r["v"])) for r in similar.confirmed(texts, 5, 0.8, block=7).collect()}
    assert links == {frozenset((2 * i, 2 * i + 1)) for i in range(30) if alike[i]}


@pytest.mark.parametrize("block", [3, 8, 1000])
def test_families_in_blocks_lose_no_link(spark, block):
    import pyarrow as pa

    rnd = random.Random(block)
    # two large families, some small ones, and a bridge between families of different blocks
    value = [i // 40 * 1000 + rnd.randint(0, 60) for i in range(80)] + [5000 + 100 * k + j for k in range(6) for j in range(2)] + [9000 + 50 * k for k in range(15)]

    def compare(table):
        v, rep, side = table["value"].to_pylist(), table["rep"].to_pylist(), table["block"].to_pylist()
        cross = table["low"][0].as_py() != table["high"][0].as_py()
        found = [(a, b) for x, a in enumerate(rep) for y, b in enumerate(rep) if a < b and abs(v[x] - v[y]) <= 9 and (not cross or side[x] != side[y])]
        return pa.table([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["u", "v"])

    frame = spark.createDataFrame([(i, g, v, 1 / block) for g in (0, 1) for i, v in enumerate(value)], "rep long, g long, value long, weight double")
    got = {r["node"]: r["component"] for r in graph.components(similar.spanning(frame, ["g"], compare)).collect()}
    parent = list(range(len(value)))
    for i in range(len(value)):
        for j in range(i):
            if abs(value[i] - value[j]) <= 9:
                a, b = _find(parent, i), _find(parent, j)
                parent[max(a, b)] = min(a, b)
    assert all(got.get(i, i) == _find(parent, i) for i in range(len(value)))


def test_quality_uses_labels_of_documents_and_all_documents(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefg") for _ in range(4)) for _ in range(200)]
    rows = [" ".join(rnd.choice(words) + ("%%%" if i % 3 == 0 else "") for _ in range(20)) for i in range(4000)]
    docs = _docs(spark, rows)
    # nearly all labels are of other documents
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(300)] + [(10**6 + i, 1, 0) for i in range(20000)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels, labelled=300)
    assert model.quality is not None and model.toxic is None
    features = docs.select("doc_id", quality.row_key().alias("row"), *quality._input(docs)).mapInArrow(quality._features, quality._FEATURES)
    got = features.where("doc_id < 500").toArrow()
    views, y = quality._read(got), np.array([float(i % 3 != 0) for i in got["doc_id"].to_pylist()])
    learner = quality.Learner(views, y, np.arange(500) % 5 == 0)
    logits = quality.view_logits(features, [learner])
    assert logits.count() == 4000
    by = sorted(((r["logits"][0], r["doc_id"]) for r in logits.collect()), reverse=True)
    best = quality.surest(logits, 0, set(), True, given=30)
    assert {i for i, _ in best} <= {i for x, i in by if x >= by[29][0]} and len(best) == 30
    again = quality.surest(logits, 0, set(best), True, given=30)
    assert len(again) == 30 and not set(again) & set(best)
    for buckets in ([], [0, 65535, 65536, quality.BUCKETS - 1]):
        assert quality._unpacked(quality._packed(np.array(buckets, np.int64))).tolist() == buckets


#: A sentence of each kind that a word list could miss.
LICENCE_EXAMPLES = {
    "Released under CC BY 4.0.": "CC-BY",
    "Available under CC BY-SA 4.0": "CC-BY-SA",
    "Released under Creative Commons Attribution 4.0": "CC-BY",
    "Available under CC BY-NC-SA 4.0": "CC-BY-NC-SA",
    "CC0 1.0 Universal": "CC0-1.0",
    "This is free and unencumbered software released into the public\ndomain.": "Unlicense",
    "# SPDX-License-Identifier: MIT\nimport os": "MIT",
    "x\n// SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "/* SPDX-License-Identifier: GPL-2.0-only */": "GPL-2.0",
}


def test_licence_scan_identifies_every_sentence():
    own = licences.Rules.of({"House": "all of this is ours", "Joke": "share and enjoy .*"}, [("House-1", ("House", "Joke")), ("Joke", ("Joke",))])
    text = "Nothing. All of this is ours.\nShare and enjoy it, friend. Share and enjoy? Released under the MIT License."
    assert own.scan(text)[1:] == (["House-1"], [])
    assert own.scan("Share and enjoy all day.")[1] == ["Joke"]
    use = licences.Rules.of()
    page = "\n\n".join([*LICENCE_EXAMPLES, "Just prose, of no licence.", text, "Licensed under the GNU Affero General Public License v3.0.", "Released under the GNU Lesser General Public License version 2.1."])
    want = [k for _, x in licences.sentences(page) if (k := use.identify(x))]
    assert [k for k, _, _ in use.scan(page)[0]] == want and {"Agpl3Licensed", "Lgpl21Licensed", "MitLicensed"} <= set(want)


@pytest.mark.parametrize("text", LICENCE_EXAMPLES)
def test_licence_filter_is_necessary(text):
    assert licences.Rules.of().scan(text)[1:] == ([LICENCE_EXAMPLES[text]], [])


def test_licence_filter_passes_every_pattern():
    sre = pytest.importorskip("re._parser")

    def write(parsed, rnd):
        out = ""
        for op, value in parsed:
            name = str(op)
            if name == "LITERAL":
                out += chr(value)
            elif name == "IN":
                kind, first = value[0]
                out += chr(first[0] if str(kind) == "RANGE" else first)
            elif name == "ANY":
                out += "q"
            elif name == "BRANCH":
                out += write(rnd.choice(value[1]), rnd)
            elif name == "SUBPATTERN":
                out += write(value[-1], rnd)
            else:
                low, _, inner = value
                for _ in range(low or rnd.randint(0, 1)):
                    out += write(inner, rnd)
        return out

    rnd = random.Random(5)
    for name, pattern in licences.SENTENCES.items():
        for _ in range(200):
            plain = write(sre.parse(pattern), rnd)
            assert re.fullmatch(pattern, plain)
            for text in (plain, plain.upper().replace(" ", "\n "), plain.replace(" ", " - ")):
                assert licences._NEEDED.search(text), (name, text)


def test_decontamination_keeps_repeated_rows_with_blocks(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    docs = _docs(spark, [passage, passage, passage, passage, "clean", "clean"], [1, 1, None, None, 2, 2])
    items = spark.createDataFrame([(1, passage), (2, " ".join(f"v{i}" for i in range(12))), (3, passage + " more")], "item_id long, text string")
    plain = lambda size: sorted((repr(tuple(r)) for r in decontaminate.decontaminate(docs, items, block_bytes=size).collect()))
    assert len(plain(20)) == 6
    assert plain(20) == plain(1 << 24)


NAMED_LICENCES = {
    "License: MIT": ["MIT"],
    "MIT License\nCopyright (c) 2020 X": ["MIT"],
    "Code is MIT licensed.": ["MIT"],
    "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007": ["GPL-3.0"],
    "GNU General Public License\nVersion 2, June 1991": ["GPL-2.0"],
    "Apache License\n Version 2.0, January 2004": ["Apache-2.0"],
    "License: EUPL-1.2": ["EUPL-1.2"],
    "Licensed under the EUPL, Version 1.2": ["EUPL-1.2"],
    "SPDX-License-Identifier: MIT OR Apache-2.0": ["MIT", "Apache-2.0"],
    "// SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0) AND BSD-3-Clause": ["GPL-2.0 WITH Classpath-exception-2.0", "BSD-3-Clause"],
    'version = "1"\nlicense = "BSD-3-Clause"\nname = "x"': ["BSD-3-Clause"],
    "License: GPL-3.0+": ["GPL-3.0-or-later"],
    "License: GPLv2+": ["GPL-2.0-or-later"],
    "Dual licensed under MIT and Apache 2.0.": ["MIT", "Apache-2.0"],
    "This project is licensed under the terms of the MPL 2.0, see LICENSE.": ["MPL-2.0"],
    "The license is the ISC license.": ["ISC"],
    "All code is BSD-2-Clause licensed.": ["BSD-2-Clause"],
    "Pictures are published under the CC BY-NC-ND 4.0 license.": ["CC-BY-NC-ND"],
    "The license is great.": [], "A driving license: ask the office.": [], "License: see below": [], "SPDX-License-Identifier: MIT foo": [], "He sat under the sun and was licensed to drive.": [], "MIT is a school.": [], "The Vim license plate, 3 June": [],
}


@pytest.mark.parametrize("text", NAMED_LICENCES)
def test_named_licences(text):
    assert licences.Rules.of().scan(f"Some words before.\n\n{text}\n\nAnd some after.")[1] == NAMED_LICENCES[text]


def test_gaps_in_rules_equal_brute_force():
    """Every way to place a rule with gaps is tried; the longest rule at the first free place wins, then the earliest places."""
    rnd = random.Random(12)
    known = {c: f"sentence {c}" for c in "abcdefg"}
    for _ in range(300):
        rules = [(f"L{k}", tuple(rnd.choice("abcd") for _ in range(rnd.randint(1, 4)))) for k in range(rnd.randint(1, 4))]
        letters = [rnd.choice("abcdefg") for _ in range(rnd.randint(0, 9))]
        text = "\n\n".join(x for c in letters for x in (f"Sentence {c}.", "Unknown words stand here."))
        use, free, want = licences.Rules.of(known, rules), list(range(len(letters))), []
        ordered = sorted(rules, key=lambda r: -len(r[1]))
        left = []
        while free:
            at, done = free[0], None
            for name, rule in ordered:
                ways = [w for w in itertools.combinations(free, len(rule)) if w[0] == at and [letters[i] for i in w] == list(rule) and all(b - a <= licences.GAP + 1 for a, b in itertools.pairwise(w))]
                # places are taken greedily, so the first way in order, if the greedy one is a way at all
                greedy = [at]
                for c in rule[1:]:
                    nxt = next((i for i in free if greedy[-1] < i <= greedy[-1] + licences.GAP + 1 and letters[i] == c), None)
                    greedy = greedy + [nxt] if nxt is not None else []
                    if not greedy:
                        break
                if letters[at] == rule[0] and greedy:
                    assert tuple(greedy) in ways and tuple(greedy) == min(ways)
                    done = (name, greedy)
                    break
            if done:
                want += [done[0]] * (done[0] not in want)
                free = [i for i in free if i not in done[1]]
            else:
                left.append(letters[at])
                free = free[1:]
        found, got, unexplained = use.scan(text)
        assert [k for k, _, _ in found] == letters and (got, unexplained) == (want, left)


def test_licence_scan_is_linear():
    for unit in ("the license is ", "license:", "licensed under the ", "gnu general public license ", "licensed under mit and ", "\nlicense: "):
        text = unit * (500_000 // len(unit))
        began = time.perf_counter()
        licences.Rules.of().scan(text)
        assert time.perf_counter() - began < 30
