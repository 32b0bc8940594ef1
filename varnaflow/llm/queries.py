"""The operators' queries, each over its whole table, and SQL where SQL can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import conversations, decontaminate, embeddings, licences, mixing, packing, pii, quality, simhash, suffix_dedup, token_store, vector_codes, window_dedup
from .encoding import tokenizer_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan_licences(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("licences", ",").alias("licences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.size("licences").cast("long").alias("n_licences"), F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("unexplained", ",").alias("unexplained"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontaminate.report(hits)


def op4_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = window_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_embedding_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_store(_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, end_id=0)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents"))
    counts = [f"n_{kind}" for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversations.damaged(_table(spark, sf_dir, "conversations"))
    return conversations.report(conversations.repair(turns, F.col("present")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = vector_codes.compress(_table(spark, sf_dir, "embeddings"), parts=4, entries=256, scale=1024, rounds=4)
    digest = hashlib.sha256(",".join(map(str, codes.codebooks.reshape(-1).tolist())).encode()).hexdigest()
    found = vector_codes.label_errors(codes.table)
    return found.select("vec_id", vector_codes.hex_code(F.col("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(_table(spark, sf_dir, "documents"), weights=(5, 2, 1))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_licence_scan, op3_decontamination, op4_window_dedup, op5_embedding_forest, op6_token_store, op7_best_fit_packing, op8_quality, op9_suffix_dedup, op10_pii, op11_conversation_repair, op12_vector_codes, op13_source_mix)}


_ITEM_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_DECONTAMINATION = f"""
WITH item AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
  win AS (SELECT DISTINCT item_id, size, array_to_string(w[k:k + size - 1], ' ') AS s FROM (
    SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM item WHERE len(w) > 0)),
  sizes AS (SELECT DISTINCT size FROM win),
  doc AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
  hit AS (SELECT doc_id, k, size, item_id FROM (
    SELECT doc_id, k, size, array_to_string(w[k:k + size - 1], ' ') AS s FROM (
      SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM doc, sizes WHERE len(w) >= size)) JOIN win USING (size, s)),
  words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM hit) GROUP BY doc_id),
  items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_WINDOW_DEDUP = """
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  win AS (SELECT doc_id, k, array_to_string(w[k:k + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM doc WHERE len(w) >= 13)),
  first AS (SELECT s, min(doc_id) AS d FROM win GROUP BY s HAVING count(*) > 1),
  gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(k, k + 13)) AS p FROM win JOIN first USING (s) WHERE d < doc_id) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: ps IS NULL OR NOT list_contains(ps, i)), ' ')) AS kept_sha256
FROM doc LEFT JOIN gone USING (doc_id)
"""

_EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
  reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
  least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
  n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN least USING (vec_id) LEFT JOIN n USING (vec_id)
"""


def _vector_codes_sql(rounds: int = 4, entries: int = 256) -> str:
    """Lloyd's rounds written out: a{k} are the assignments to the codebooks c{k}, which the sums over a{k-1} give."""
    tables = [
        "v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, q) AS id, * FROM (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0))",
        "p AS MATERIALIZED (SELECT id, part, q[part * len(q) // 4 + 1:(part + 1) * len(q) // 4] AS x FROM v, (SELECT unnest(range(4)) AS part))",
        f"c0 AS MATERIALIZED (SELECT part, id - 1 AS e, x AS c FROM p WHERE id <= {entries})",
    ]
    for k in range(rounds + 1):
        tables.append(f"a{k} AS MATERIALIZED (SELECT id, part, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT id, part, e, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS d FROM p JOIN c{k} USING (part)) GROUP BY id, part)")
        if k < rounds:
            tables.append(f"""c{k + 1} AS MATERIALIZED (SELECT c{k}.part, c{k}.e, coalesce(m.c, c{k}.c) AS c FROM c{k} LEFT JOIN (SELECT part, e, list(y ORDER BY i) AS c FROM (
      SELECT part, e, i, floor(sum(y) / count(*)) AS y FROM (SELECT part, e, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM p JOIN a{k} USING (id, part)) GROUP BY ALL) GROUP BY ALL) m USING (part, e))""")
    last = f"a{rounds}"
    return f"""WITH {", ".join(tables)},
  coded AS (SELECT id, string_agg(lpad(lower(hex(e)), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM {last} GROUP BY id),
  books AS (SELECT sha256(coalesce(string_agg(y::BIGINT::VARCHAR, ',' ORDER BY part, e, i), '')) AS codebooks_sha256 FROM (SELECT part, e, unnest(c) AS y, generate_subscripts(c, 1) AS i FROM c{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN coded USING (id), books"""


#: What is taken of a document follows from its place in its source's shuffled stream: whole rounds of the stream, and the part of the last that covers it.
_SOURCE_MIX = """
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
  s AS MATERIALIZED (SELECT source, source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
  fill(k, level) AS (SELECT 0, 1.5 * sum(source_size) / sum(w) FROM s
    UNION ALL SELECT k + 1, (SELECT (1.5 * sum(source_size) - 2 * sum(CASE WHEN w * level >= 2 * source_size THEN source_size ELSE 0 END)) / nullif(sum(CASE WHEN w * level >= 2 * source_size THEN 0 ELSE w END), 0) FROM s) FROM fill WHERE k < 60 AND level IS NOT NULL),
  t AS MATERIALIZED (SELECT source, source_size, least(2.0 * source_size, w * (SELECT max(level) FROM fill))::DOUBLE AS target FROM s),
  placed AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY md5('27:' || coalesce(doc_id::VARCHAR, 'null')), size ROWS UNBOUNDED PRECEDING) - size AS a FROM d)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE (size * (round(target)::BIGINT // source_size) + greatest(0, least(a + size, round(target)::BIGINT % source_size) - a))::BIGINT END AS taken
FROM placed JOIN t ON placed.source IS NOT DISTINCT FROM t.source
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of those that it can express over whole tables in reasonable time.

    The others need XXH64 (op1), pattern rules (op2), a tokenizer (op6, op7), a fitted
    model (op8), every byte window (op9), transducers (op10) or CRC-32 (op11); tests
    hold them against brute force.
    """
    return {"op3_decontamination": _DECONTAMINATION, "op4_window_dedup": _WINDOW_DEDUP, "op5_embedding_forest": _EMBEDDINGS, "op12_vector_codes": _vector_codes_sql(), "op13_source_mix": _SOURCE_MIX}
