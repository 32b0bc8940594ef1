"""The engine's queries over the driver's tables, and the same in DuckDB SQL.

Stand-ins: ``documents.text`` lines and ``conversations.text`` are sentences,
``VOCABULARY`` is the English list, a dictionary is built from the words
themselves, and transliterated text is the Devanagari side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunks import chunk_text
from ..functions.folding import fold_to_ascii
from ..functions.metrics import cer_of, char_bleu, char_errors, length_score, matched_ngrams, position_score, window_bounds, word_errors, words_in_place
from ..functions.normalize import rule_based, rule_text, vocabulary_test
from ..functions import tables
from ..functions.phonetic import SYMBOLS, primary_code
from ..functions.repair import matched_words, repair, replacement_lines
from ..functions.text import (
    clean_token,
    contains_devanagari,
    corpus_text,
    corpus_words,
    devanagari_digits,
    devanagari_runs,
    digit_run_positions,
    digit_runs,
    keep_devanagari,
    log_curve,
    mask_english,
    numbered_line,
    plain_lower,
    remove_emojis,
    repair_separators,
    restore_english,
    roman_devanagari_pair,
    words,
)
from ..functions.translit import CONSONANTS, MARKS, UNITS, VOWELS, english_pairs, english_spelling, english_to_devanagari, transliterate
from ..operators import aggregates, filters, joins, samples, sets, vectors, windows
from ..operators.scans import kept, prefix_scan
from ..session import ship
from ..sources.readers import spread, table_lines
from . import dictionary, evaluation, files, normalization, romanized

VOCABULARY = "the of and to in a is that it for with was on as be by this are at or from an not have new job market price school".split()
_ENGLISH = vocabulary_test(VOCABULARY)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(ship(spark).read.parquet(f"{sf_dir}/{name}.parquet"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_lines(_table(spark, sf_dir, "documents"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def _vocabulary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in VOCABULARY], "word string")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, n): the different words of all documents."""
    return aggregates.distinct_lower(_table(spark, sf_dir, "documents"), corpus_words(F.col("text")))


_built: dict[tuple[str, str], DataFrame] = {}


def _new_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.variant_groups(_table(spark, sf_dir, "documents"), "text", _vocabulary(spark))


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variant dictionary as other queries use it: built once in an application and stored in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        _built[key] = kept(_new_groups(spark, sf_dir), "variants")
    return _built[key]


def _long(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


# SQL pieces ------------------------------------------------------------------

_PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
#: White space as the functions take it, whatever the engine's own class is.
_WS = "\\x{0009}-\\x{000D}\\x{001C}-\\x{0020}\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{_WS}]+', ' ', 'g'))"


def _split(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{_WS}]+'), lambda w: w <> '')"


_VOCAB = "[" + ", ".join(map(_q, VOCABULARY)) + "]"
_LINES = f"""lines AS (
  SELECT doc_id, line_no, {_strip("raw")} AS line FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)
  WHERE {_strip("raw")} <> '')"""
_EMOJI = "[\\x{2500}-\\x{2BEF}\\x{24C2}-\\x{1F251}\\x{2640}-\\x{2642}\\x{2600}-\\x{2B55}\\x{200d}\\x{23cf}\\x{23e9}\\x{231a}\\x{fe0f}\\x{3030}\\x{10000}-\\x{10FFFF}]+"


def _no_emoji(x: str) -> str:
    return _squeeze(f"regexp_replace({x}, '{_EMOJI}', '', 'g')")


def _separators(x: str) -> str:
    for sign in ("\\.", "\\(", "\\)"):
        x = f"regexp_replace({x}, '([a-zA-Z]){sign}([a-zA-Z])', '\\1 \\2', 'g')"
    return _squeeze(f"regexp_replace({x}, '[()]', ' ', 'g')")


def _corpus(x: str) -> str:
    x = f"regexp_replace({x}, '[\\x{{1F000}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}\\x{{2B50}}\\x{{2B55}}\\x{{231A}}\\x{{231B}}\\x{{23E9}}-\\x{{23F3}}\\x{{fe0f}}\\x{{200d}}]', '', 'g')"
    x = f"regexp_replace(lower({x}), 'http[^{_WS}]+|www[^{_WS}]+|https[^{_WS}]+', '', 'g')"
    return _squeeze(f"translate(regexp_replace({x}, '\\p{{Nd}}+', ' ', 'g'), '{_PUNCT}', '')")


_WORDS = f"""words AS (
  SELECT word, count(*) AS n FROM (SELECT unnest({_split(_corpus("text"))}) AS word FROM documents)
  GROUP BY word)"""


def _spelled(w: str) -> str:
    x = f"translate(lower({w}), 'āīūṁṃñṙ', 'aiummnr')"
    for pattern, new in (("[^a-z]", ""), ("xo", "cho"), ("xh", "ch"), *((f"{v}{{2,}}", v) for v in "aeiou"), ("ae", "ai"), ("chh", "CH"), *((d, d.upper()) for d in "ch kh gh ph bh jh th dh sh ng".split()), ("f", "PH"), ("x", "X")):
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return f"CASE WHEN length({w}) = 2 THEN replace(upper({w}), 'ẞ', 'SS') ELSE {_at_most_twice(x)} END"


def _at_most_twice(x: str) -> str:
    """No character more than twice in a row."""
    return f"list_aggregate(list_filter(string_split({x}, ''), lambda c, i: i < 3 OR c <> string_split({x}, '')[i - 1] OR c <> string_split({x}, '')[i - 2]), 'string_agg', '')"


def _map(pairs: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in pairs.items()) + "}"


def _coded(table: str, word: str = "word") -> str:
    """A query that adds the primary code of each word."""
    return f"""(SELECT *, heard || CASE WHEN n_heard < 6 AND last_sound IN ('a','e','i','o','u') AND upper(last_sound) <> heard[-1] THEN upper(last_sound) ELSE '' END AS code FROM (
      SELECT *, array_to_string(list_slice(diff, 1, 6), '') AS heard, least(len(diff), 6) AS n_heard FROM (
        SELECT *, list_filter(syms, lambda s, i: i = 1 OR s <> syms[i - 1]) AS diff FROM (
          SELECT *, sounds[-1] AS last_sound, list_transform(list_filter(sounds, lambda s, i: i = 1 OR s NOT IN ('a','e','i','o','u')),
            lambda s: CASE WHEN s IN ('a','e','i','o','u') THEN upper(s) ELSE coalesce({_map(SYMBOLS)}[s], {_map(SYMBOLS)}[lower(s)], upper(s)) END) AS syms FROM (
            SELECT *, regexp_extract_all({_spelled(word)}, '(?:CH|KH|GH|PH|BH|JH|TH|DH|SH|NG|.)') AS sounds FROM {table})))))"""


_GROUPS = f"""groups AS (
  SELECT code, arg_min(word, (-n, word)) AS base_word, list_sort(list(word)) AS variants, count(*) AS n
  FROM {_coded(f"(SELECT * FROM words WHERE NOT list_contains({_VOCAB}, word))")} WHERE code <> '' GROUP BY code HAVING count(*) >= 2)"""
_PVD = "pvd AS (SELECT unnest(variants) AS variant, base_word AS base FROM groups)"


def _deva(x: str) -> str:
    """Devanagari of a lower-case expression."""
    c, v, s, m = _map(CONSONANTS), _map({k: a for k, (a, _) in VOWELS.items()}), _map({k: b for k, (_, b) in VOWELS.items()}), _map(MARKS)
    return f"""(SELECT array_to_string(list_transform(u, lambda x, i: CASE
        WHEN {c}[x] IS NOT NULL THEN {c}[x] || CASE WHEN i < len(u) AND {c}[u[i + 1]] IS NOT NULL THEN '्' ELSE '' END
        WHEN {v}[x] IS NOT NULL THEN CASE WHEN i > 1 AND {c}[u[i - 1]] IS NOT NULL THEN {s}[x] ELSE {v}[x] END
        ELSE coalesce({m}[x], x) END), '') FROM (SELECT regexp_extract_all({x}, '(?s:{"|".join(UNITS)}|.)') AS u))"""


_RULED = f"""(SELECT *, regexp_extract(w0, '^([^\\pL\\pN]*)', 1) AS prefix, lower(regexp_extract(w0, '^[^\\pL\\pN]*(.*?)[^\\pL\\pN]*$', 1)) AS core,
  CASE WHEN regexp_matches(w0, '[\\pL\\pN]') THEN regexp_extract(w0, '([^\\pL\\pN]*)$', 1) ELSE '' END AS suffix FROM (
  SELECT conv_id, turn, unnest({_split("t")}) AS w0, generate_subscripts({_split("t")}, 1) AS pos FROM ruled_turns))"""
#: Letters with marks and what they fold to, written out again for the other engine (fixed values).
_MARKED = {
    "a": "àáâãäåāăą", "c": "çćĉċč", "d": "ďđ", "e": "èéêëēĕėęě", "g": "ĝğġģ", "h": "ĥħḥ", "i": "ìíîïĩīĭįı", "j": "ĵ", "k": "ķ", "l": "ĺļľŀłḷ", "m": "ṁṃ", "n": "ñńņňṅṇ", "o": "òóôõöøōŏő",
    "r": "ŕŗřṙṛ", "s": "śŝşšṣ", "t": "ţťŧṭ", "u": "ùúûüũūŭůűų", "w": "ŵ", "y": "ýÿŷ", "z": "źżž", "''": "’‘", '"': "“”", "-": "–—", "ss": "ß", "ae": "æ", "oe": "œ", "th": "þ", "ij": "ĳ", ".": "…",
}


def _folded(x: str) -> str:
    for to, marked in _MARKED.items():
        x = f"regexp_replace({x}, '[{marked}]', '{to}', 'g')"
    return f"replace(replace({x}, 'ḍ', 'd'), 'ð', 'd')"


def _ruled_of(x: str) -> str:
    """The sentence rules of an expression."""
    return f"(SELECT regexp_replace({_at_most_twice('s')}, '[^\\pL\\pN_\\s.,!?;:''\"-]', '', 'g') FROM (SELECT {_squeeze(_folded(f'lower({x})'))} AS s))"


_RULED_TURNS = f"ruled_turns AS (SELECT conv_id, turn, role, text, {_ruled_of('text')} AS t FROM conversations)"


Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and its SQL."""

    def keep(f: Query) -> Query:
        _FOUND[f.__name__] = (f, sql)
        return f

    return keep


# Dictionary build ------------------------------------------------------------


@_query(f"WITH {_WORDS}, {_GROUPS} SELECT code, base_word, array_to_string(variants, ' ') AS variants, n FROM groups")
def variant_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1 SC6 SC7 AGG3 FLT3 SET4 SC23 AGG5 JN6 D15: unknown words grouped by phonetic code."""
    return _new_groups(spark, sf_dir).select("code", "base_word", F.array_join("variants", " ").alias("variants"), "n")


@_query(f"WITH {_WORDS} SELECT word, n FROM words WHERE NOT list_contains({_VOCAB}, word)")
def unknown_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT3 SET4 AGG3: distinct words that aren't English."""
    return filters.not_in(_words(spark, sf_dir), "word", _vocabulary(spark)).select("word", "n")


@_query(f"WITH {_WORDS} SELECT word, code FROM {_coded('words')}")
def phonetic_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC23 WIN4: the primary code of each word."""
    return _words(spark, sf_dir).select("word", primary_code(F.col("word")).alias("code"))


@_query(f"WITH {_WORDS}, {_GROUPS}, {_PVD} SELECT count(DISTINCT base) AS bases, count(*) AS variants FROM pvd")
def dictionary_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC10 AGG17: how many bases and variants the lookup has."""
    return aggregates.base_words(dictionary.pvd_of(_groups(spark, sf_dir)))


@_query(f"WITH {_WORDS}, {_GROUPS} SELECT code, variants[1] AS head, unnest(variants[2:]) AS other FROM groups")
def block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN6: each word of a phonetic block with the block's first."""
    return joins.first_pairs(dictionary.coded_words(_table(spark, sf_dir, "documents"), "text", _vocabulary(spark)))


@_query(f"WITH {_WORDS}, {_GROUPS} SELECT to_json(MAP {{code: {{'base_word': base_word, 'variants': variants}}}})::VARCHAR AS value FROM groups")
def dictionary_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK5 D4: the dictionary as JSON entries."""
    from ..sources.writers import pvd_document

    return pvd_document(_groups(spark, sf_dir))


# Romanized filter ------------------------------------------------------------

_ANALYSED = f"""{_LINES}, cleaned AS (SELECT doc_id, line_no, line, {_no_emoji("line")} AS e FROM lines),
  counted AS (SELECT *, {_separators("e")} AS clean FROM cleaned),
  worded AS (SELECT *, list_filter({_split(f"lower(translate(clean, '{_PUNCT}', ''))")}, lambda w: NOT regexp_full_match(w, '[0-9]+')) AS ws FROM counted),
  analysed AS (SELECT *, len(list_filter(ws, lambda w: list_contains({_VOCAB}, w))) AS english_words, len(ws) AS total_words FROM worded),
  rated AS (SELECT *, total_words - english_words AS genuine_words, CASE WHEN total_words = 0 THEN 0.0 ELSE english_words::DOUBLE / total_words END AS english_ratio FROM analysed)"""


@_query(f"WITH {_ANALYSED} SELECT doc_id, line_no, round(english_ratio, 9) AS english_ratio, english_words, total_words, genuine_words FROM rated")
def sentence_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1 SC2 SC3 SC4 FLT12 JN2 D13: English ratio of every line."""
    rows = romanized.analysed(_lines(spark, sf_dir), _ENGLISH, "line")
    return rows.select("doc_id", *_long("line_no"), F.round("english_ratio", 9).alias("english_ratio"), "english_words", "total_words", "genuine_words")


@_query(
    f"WITH {_ANALYSED} SELECT english_words, total_words, genuine_words, round(english_ratio, 9) AS english_ratio, count(*) AS n FROM rated GROUP BY ALL"
)
def sentence_analysis_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC4 JN2: the same by joining a vocabulary table, as a profile."""
    rows = romanized.analysed_by_join(_lines(spark, sf_dir), _vocabulary(spark), "line", "doc_id", "line_no")
    return rows.groupBy("english_words", "total_words", "genuine_words", F.round("english_ratio", 9).alias("english_ratio")).agg(F.count("*").alias("n"))


@_query(f"WITH {_ANALYSED} SELECT doc_id, line_no, {_strip(f'''lower(translate(clean, '{_PUNCT}', ''))''')} AS sentence FROM rated WHERE clean <> '' AND english_ratio < 0.4 AND genuine_words >= 4")
def romanized_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT2 FLT5 SC5: the lines that the filter keeps."""
    kept, _ = romanized.romanized_corpus(_lines(spark, sf_dir), _ENGLISH, "line")
    return kept.select("doc_id", *_long("line_no"), "sentence")


@_query(f"""WITH {_ANALYSED}, k AS (SELECT *, clean <> '' AS c, english_ratio >= 0.4 AS h, genuine_words < 4 AS l FROM rated)
  SELECT count(*) AS original_sentences, count(*) FILTER (c) AS cleaned_sentences, count(*) FILTER (c AND NOT h AND NOT l) AS romanized_sentences,
    count(*) FILTER (c) - count(*) FILTER (c AND NOT h AND NOT l) AS removed_sentences, count(*) FILTER (c AND h AND NOT l) AS removed_high_english,
    count(*) FILTER (c AND l AND NOT h) AS removed_low_genuine, count(*) FILTER (c AND h AND l) AS removed_both_issues,
    round(count(*) FILTER (c AND NOT h AND NOT l) * 100.0 / count(*) FILTER (c), 6) AS success_rate,
    round(avg(english_ratio * 100) FILTER (c AND NOT h AND NOT l), 6) AS avg_english_ratio, round(max(english_ratio * 100) FILTER (c AND NOT h AND NOT l), 6) AS max_english_ratio,
    round(min(english_ratio * 100) FILTER (c AND NOT h AND NOT l), 6) AS min_english_ratio, round(avg(genuine_words) FILTER (c AND NOT h AND NOT l), 6) AS avg_genuine_words,
    min(genuine_words) FILTER (c AND NOT h AND NOT l) AS min_genuine_words, max(genuine_words) FILTER (c AND NOT h AND NOT l) AS max_genuine_words,
    count(*) FILTER (e <> line) AS emoji_fixes, count(*) FILTER (clean <> e) AS separator_fixes FROM k""")
def romanized_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG1 AGG2 FLT13 D14: the filter's report."""
    _, stats = romanized.romanized_corpus(_lines(spark, sf_dir), _ENGLISH, "line")
    rounded = ("success_rate", "avg_english_ratio", "max_english_ratio", "min_english_ratio", "avg_genuine_words")
    return stats.select(*[F.round(c, 6).alias(c) if c in rounded else F.col(c) for c in stats.columns])


@_query(f"""WITH {_ANALYSED}, f AS (SELECT *, 'dir/src' || source || '.txt' AS file FROM rated JOIN (SELECT doc_id, source FROM documents) USING (doc_id))
  SELECT 'src' || regexp_extract(file, 'dir/src(.*)[.]txt', 1) || '_romanized.txt' AS output, count(*) AS sentences, count(*) FILTER (clean <> '' AND english_ratio < 0.4 AND genuine_words >= 4) AS kept FROM f GROUP BY file""")
def romanized_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC45 SC47: the filter over many files at once."""
    docs = _table(spark, sf_dir, "documents")
    named = docs.where("doc_id is not null").select("text", F.concat(F.lit("dir/src"), "source", F.lit(".txt")).alias("file"))
    lines = table_lines(named, "file").select(F.col("doc_id").alias("file"), F.col("line").alias("value"))
    return romanized.per_file(lines, _ENGLISH).select("output", "sentences", "kept")


@_query(f"WITH {_LINES} SELECT coalesce(doc_id, -1) AS doc_id, count(*) AS n FROM lines GROUP BY ROLLUP (doc_id)")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG7 SRC2: lines of each document and of all."""
    return aggregates.line_counts(_lines(spark, sf_dir), "doc_id").select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "n")


@_query(f"""WITH {_LINES}, s AS (SELECT line, len({_split("line")}) AS w, length(line) AS c FROM lines)
  SELECT round(avg(w), 6) AS avg_words, min(w) AS min_words, max(w) AS max_words, round(avg(c), 6) AS avg_chars, min(c) AS min_chars, max(c) AS max_chars, count(*) AS n,
    (SELECT md5(line) FROM s ORDER BY c, line LIMIT 1) AS shortest, (SELECT md5(line) FROM s ORDER BY c, line OFFSET (SELECT count(*) // 2 FROM s) LIMIT 1) AS median, (SELECT md5(line) FROM s ORDER BY c DESC, line DESC LIMIT 1) AS longest FROM s""")
def length_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG6 ORD3: lengths, and the shortest, median and longest line."""
    p = aggregates.length_profile(_lines(spark, sf_dir), "line")
    md5 = [F.md5(F.col(c).cast("binary")).alias(c) for c in ("shortest", "median", "longest")]
    return p.select(F.round("avg_words", 6).alias("avg_words"), *_long("min_words", "max_words"), F.round("avg_chars", 6).alias("avg_chars"), *_long("min_chars", "max_chars"), "n", *md5)


# Scalars ---------------------------------------------------------------------


@_query(f"""WITH {_LINES} SELECT doc_id, line_no, md5(regexp_replace(line, '[^A-Za-z0-9\\x{{0900}}-\\x{{097F}}'']+', '', 'g')) AS token, md5({_no_emoji("line")}) AS emoji, md5({_separators("line")}) AS separators,
  md5({_strip(f"lower(translate(line, '{_PUNCT}', ''))")}) AS plain, md5({_corpus("line")}) AS corpus, len({_split("line")}) AS words FROM lines""")
def text_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC1 SC2 SC3 SC5 SC6 SC7: every cleaner over every line, as digests."""
    line = F.col("line")
    md5 = lambda c, name: F.md5(c.cast("binary")).alias(name)
    return _lines(spark, sf_dir).select("doc_id", *_long("line_no"), md5(clean_token(line), "token"), md5(remove_emojis(line), "emoji"), md5(repair_separators(line), "separators"), md5(plain_lower(line), "plain"), md5(corpus_text(line), "corpus"), F.size(words(line)).cast("long").alias("words"))


@_query(f"WITH {_WORDS} SELECT word, {_deva('word')} AS devanagari FROM words")
def transliterated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC24 WIN7 D10: Devanagari of every word."""
    return _words(spark, sf_dir).select("word", transliterate(F.col("word")).alias("devanagari"))


def _english_sound(w: str) -> str:
    from ..functions.translit import ENGLISH_SOUNDS, ENGLISH_SPELLINGS

    x = plain = f"regexp_replace({w}, '[^a-z'']+', '', 'g')"
    for old, new in ENGLISH_SOUNDS:
        x = f"replace({x}, '{old}', '{new}')"
    return f"coalesce({_map(ENGLISH_SPELLINGS)}[{plain}], {x})"


@_query(f"""WITH {_WORDS} SELECT word, sound, coalesce(MAP {{'school': 'स्कुल'}}[word], deva) AS devanagari FROM (
  SELECT word, sound, {_deva("sound")} AS deva FROM (SELECT word, {_english_sound("word")} AS sound FROM words))""")
def english_words_in_devanagari(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC25 SC26 SC27: English spellings made sounds, then Devanagari."""
    w = F.col("word")
    return _words(spark, sf_dir).select("word", english_spelling(w).alias("sound"), english_to_devanagari(w).alias("devanagari"))


@_query(f"""WITH {_WORDS}, d AS (SELECT word, n, {_deva("word")} || ' १२ ' || word AS mixed FROM words)
  SELECT word, regexp_matches(mixed, '[ऀ-ॿ]') AS has_devanagari, array_to_string(regexp_extract_all(mixed, '[\\x{{0900}}-\\x{{097F}}]+'), '|') AS runs, {_strip("regexp_replace(mixed, '[^\\x{0900}-\\x{097F}\\s]', '', 'g')")} AS kept,
    translate(n::VARCHAR, '0123456789', '०१२३४५६७८९') AS digits FROM d""")
def devanagari_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT1 FLT11 SC30 SC42 SC43: Devanagari predicates, runs and digits."""
    w = F.col("word")
    mixed = F.concat(transliterate(w), F.lit(" १२ "), w)
    return _words(spark, sf_dir).select("word", contains_devanagari(mixed).alias("has_devanagari"), F.array_join(devanagari_runs(mixed), "|").alias("runs"), keep_devanagari(mixed).alias("kept"), devanagari_digits(F.col("n")).alias("digits"))


@_query(f"""WITH {_LINES} SELECT doc_id, line_no, array_to_string(regexp_extract_all(line, '[0-9]+'), '|') AS digits FROM lines WHERE regexp_matches(line, '[0-9]')""")
def digit_runs_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC31: digit runs."""
    return _lines(spark, sf_dir).where(F.col("line").rlike("[0-9]")).select("doc_id", *_long("line_no"), F.array_join(digit_runs(F.col("line")), "|").alias("digits"))


@_query(f"""WITH {_LINES}, c AS (SELECT doc_id, line_no, line, string_split(line, '') AS cs FROM lines WHERE regexp_matches(line, '[0-9]')),
  p AS (SELECT doc_id, line_no, list_filter(range(0, len(cs)), lambda i: regexp_matches(cs[i + 1], '\\p{{Nd}}') AND (i = 0 OR NOT regexp_matches(cs[i], '\\p{{Nd}}'))) AS starts, regexp_extract_all(line, '\\p{{Nd}}+') AS runs FROM c)
  SELECT doc_id, line_no, unnest(starts) AS pos, unnest(runs) AS digits FROM p""")
def digit_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC31: digit runs with their places."""
    rows = _lines(spark, sf_dir).where(F.col("line").rlike("[0-9]")).select("doc_id", *_long("line_no"), F.explode(digit_run_positions(F.col("line"))).alias("r"))
    return rows.select("doc_id", "line_no", "r.pos", "r.digits")


@_query(f"""WITH {_LINES}, m AS (SELECT doc_id, line_no, regexp_extract_all(replace(line, '#', ''), '[\\pL\\pN_]+|[^\\pL\\pN_\\s]') AS toks FROM lines)
  SELECT doc_id, line_no, md5(array_to_string(list_transform(toks, lambda t: CASE WHEN list_contains({_VOCAB}, lower(t)) THEN '#' ELSE t END), ' ')) AS masked, array_to_string(list_filter(toks, lambda t: list_contains({_VOCAB}, lower(t))), ' ') AS words, md5(array_to_string(toks, ' ')) AS restored FROM m""")
def masked_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC39 SC40: English words masked and put back."""
    m = _lines(spark, sf_dir).select("doc_id", *_long("line_no"), mask_english(F.col("line"), _ENGLISH).alias("m"))
    digest = lambda c: F.md5(c.cast("binary"))
    return m.select("doc_id", "line_no", digest(F.col("m.masked")).alias("masked"), F.array_join("m.words", " ").alias("words"), digest(restore_english(F.col("m.masked"), F.col("m.words"))).alias("restored"))


@_query(f"""WITH {_LINES} SELECT doc_id, line_no, md5(line) AS answer FROM lines""")
def numbered_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC22: answers of numbered lines."""
    rows = _lines(spark, sf_dir).withColumn("numbered", F.concat(F.col("line_no") + 1, F.lit(". "), "line"))
    return rows.select("doc_id", *_long("line_no"), F.md5(numbered_line(F.col("numbered")).cast("binary")).alias("answer"))


@_query(f"""WITH {_WORDS}, l AS (SELECT word || ' , ' || {_deva("word")} || ',' AS line FROM words),
  c AS (SELECT trim(regexp_extract(line, '^([^\\x{{0900}}-\\x{{097F}}]*)', 1), ' ,') AS romanized, trim(regexp_extract(line, '^[^\\x{{0900}}-\\x{{097F}}]*(.*)$', 1), ' ,') AS devanagari FROM l)
  SELECT romanized, devanagari FROM c WHERE romanized <> '' AND devanagari <> ''""")
def parsed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC22 FLT14 SRC20: generated lines cut into pairs."""
    line = F.concat(F.col("word"), F.lit(" , "), transliterate(F.col("word")), F.lit(","))
    return _words(spark, sf_dir).select(roman_devanagari_pair(line).alias("p")).where("p is not null").select("p.*")


@_query("SELECT item_id::INT AS epoch, round(item_id / 10.0, 4) AS train_loss, round(item_id / 20.0, 4) AS val_loss FROM benchmark")
def training_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC44 D19: a training log parsed."""
    line = F.format_string("Epoch %d/10 | Loss  %.4f | Val Loss  %.4f", F.col("item_id"), F.col("item_id") / 10.0, F.col("item_id") / 20.0)
    return _table(spark, sf_dir, "benchmark").select(F.explode(log_curve(line)).alias("e")).select("e.*")


# Normalization ---------------------------------------------------------------


@_query(f"""WITH {_RULED_TURNS}, r AS (SELECT *, CASE WHEN NOT list_contains({_VOCAB}, core) THEN replace(core, 'x', 'chh') ELSE core END AS x FROM {_RULED})
  SELECT t0.conv_id, t0.turn, coalesce(n, '') AS normalized FROM ruled_turns t0 LEFT JOIN (SELECT conv_id, turn, string_agg(prefix || CASE WHEN NOT list_contains({_VOCAB}, x) AND x LIKE '%w' THEN x[:-2] || 'a' ELSE x END || suffix, ' ' ORDER BY pos) AS n FROM r GROUP BY conv_id, turn) USING (conv_id, turn)""")
def rule_based_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC8 SC9 SC10 SC11 SC14: the rule-based arm."""
    return _turns(spark, sf_dir).select("conv_id", "turn", rule_based(F.col("text"), _ENGLISH).alias("normalized"))


_CHANGED = f"""{_WORDS}, {_GROUPS}, {_PVD}, {_RULED_TURNS}, r AS (SELECT *, CASE WHEN NOT list_contains({_VOCAB}, core) THEN replace(core, 'x', 'chh') ELSE core END AS x FROM {_RULED}),
  w AS (SELECT *, CASE WHEN NOT list_contains({_VOCAB}, x) AND x LIKE '%w' THEN x[:-2] || 'a' ELSE x END AS y FROM r),
  f AS (SELECT w.*, base FROM w LEFT JOIN pvd ON y = variant)"""


@_query(f"""WITH {_CHANGED} SELECT t0.conv_id, t0.turn, coalesce(n, '') AS normalized, coalesce(c, 0) AS changes FROM ruled_turns t0 LEFT JOIN (
  SELECT conv_id, turn, string_agg(prefix || coalesce(base, y) || suffix, ' ' ORDER BY pos) AS n, sum((x <> core)::BIGINT + (y <> x)::BIGINT + (base IS NOT NULL)::BIGINT)::BIGINT AS c FROM f GROUP BY conv_id, turn) USING (conv_id, turn)""")
def normalized_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC12 SC13 SC14 JN1 D5 D12: rules and dictionary with their changes."""
    pvd = dictionary.pvd_of(_groups(spark, sf_dir))
    out = normalization.normalize_with_changes(_turns(spark, sf_dir), "text", _ENGLISH, pvd, "conv_id", "turn")
    return out.select("conv_id", "turn", "normalized", F.size("changes").cast("long").alias("changes"))


@_query(f"""WITH {_CHANGED} SELECT rule, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN x <> core THEN 'x → chh' END, CASE WHEN y <> x THEN 'w → a' END, CASE WHEN base IS NOT NULL THEN 'dictionary mapping' END], lambda r: r IS NOT NULL)) AS rule FROM f) GROUP BY rule""")
def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC10 SC11 SC12 D12: how often each rule fired."""
    pvd = dictionary.pvd_of(_groups(spark, sf_dir))
    out = normalization.normalize_with_changes(_turns(spark, sf_dir), "text", _ENGLISH, pvd, "conv_id", "turn")
    return out.select(F.explode("changes").alias("c")).groupBy(F.col("c.rule").alias("rule")).agg(F.count("*").alias("n"))


@_query("SELECT conv_id, turn, text, c.config, c.model FROM conversations, (SELECT unnest(['combined','rule_based','pvd_only','raw']) AS config) c0, LATERAL (SELECT c0.config AS config, unnest(['m1','m2']) AS model) c")
def config_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN8 D18: each turn once for each arm and model."""
    configs = [(arm, model) for arm in normalization.ARMS for model in ("m1", "m2")]
    return joins.with_configs(_turns(spark, sf_dir).select("conv_id", "turn", "text"), configs, "config", "model")


def _spoken(x: str) -> str:
    """Devanagari of any text: ``T D N H`` and ``Sh`` keep their case."""
    return _deva(f"translate(lower(translate(replace({x}, 'Sh', chr(57344) || 'h'), 'TDNH', chr(57345) || chr(57346) || chr(57347) || chr(57348))), chr(57344) || chr(57345) || chr(57346) || chr(57347) || chr(57348), 'STDNH')")


def _in_chunks(x: str) -> str:
    """Chunks joined again by one space; words over a chunk's length are cut."""
    cut = "array_to_string(list_transform(range(0, (length(w) + 124) // 125), lambda i: substr(w, i * 125 + 1, 125)), ' ')"
    return f"CASE WHEN length({x}) <= 125 THEN {x} ELSE array_to_string(list_transform({_split(x)}, lambda w: CASE WHEN length(w) <= 125 THEN w ELSE {cut} END), ' ') END"


@_query(f"""WITH {_CHANGED}, parts AS (SELECT conv_id, turn, pos, regexp_extract(w0, '^([^\\pL\\pN]*)', 1) AS prefix, regexp_extract(w0, '^[^\\pL\\pN]*(.*?)[^\\pL\\pN]*$', 1) AS core, CASE WHEN regexp_matches(w0, '[\\pL\\pN]') THEN regexp_extract(w0, '([^\\pL\\pN]*)$', 1) ELSE '' END AS suffix
    FROM (SELECT conv_id, turn, unnest({_split("text")}) AS w0, generate_subscripts({_split("text")}, 1) AS pos FROM conversations)),
  made AS (SELECT conv_id, turn, 'raw' AS config, text AS x FROM conversations
    UNION ALL SELECT conv_id, turn, 'rule_based', string_agg(prefix || y || suffix, ' ' ORDER BY pos) FROM w GROUP BY conv_id, turn
    UNION ALL SELECT conv_id, turn, 'combined', string_agg(prefix || coalesce(base, y) || suffix, ' ' ORDER BY pos) FROM f GROUP BY conv_id, turn
    UNION ALL SELECT conv_id, turn, 'pvd_only', string_agg(prefix || coalesce(base, core) || suffix, ' ' ORDER BY pos) FROM parts LEFT JOIN pvd ON core = variant GROUP BY conv_id, turn),
  arms AS (SELECT c.conv_id, c.turn, config, coalesce(x, '') AS x FROM (FROM conversations, (SELECT unnest(['raw', 'rule_based', 'combined', 'pvd_only']) AS config)) c LEFT JOIN made USING (conv_id, turn, config)),
  fed AS (SELECT conv_id, turn, config, 'whole' AS model, x FROM arms UNION ALL SELECT conv_id, turn, config, 'chunked', {_in_chunks("x")} FROM arms)
  SELECT conv_id, turn, config, model, {_spoken("x")} AS output FROM fed""")
def ablation_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC14 SC15 JN8 SRC3: every arm of every turn through two models."""
    pvd = dictionary.pvd_of(_groups(spark, sf_dir))
    return normalization.ablation(_turns(spark, sf_dir), "text", _ENGLISH, pvd, [("chunked", 125), ("whole", 0)], None, "conv_id", "turn")


@_query(f"""WITH {_LINES} SELECT doc_id, line_no, CASE WHEN length(line) <= 125 THEN 1 ELSE len(list_reduce(list_prepend('', list_transform({_split("line")}, lambda w: w)), lambda a, w: CASE
    WHEN a = '' THEN w WHEN length(split_part(a, chr(1), len(string_split(a, chr(1))))) + 1 + length(w) <= 125 THEN a || ' ' || w ELSE a || chr(1) || w END).string_split(chr(1))) END AS chunks FROM lines""")
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC15: greedy chunks of every line."""
    return _lines(spark, sf_dir).select("doc_id", *_long("line_no"), F.size(chunk_text(F.col("line"), 125)).cast("long").alias("chunks"))


@_query()
def served_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC36 SC37 SC38 JN7 WIN2 WIN3 SNK10: normalize, transliterate, repair."""
    pvd = dictionary.pvd_of(_groups(spark, sf_dir))
    out = normalization.serve(_turns(spark, sf_dir), "text", VOCABULARY, pvd, "conv_id", "turn")
    return out.select("conv_id", "turn", "text", F.array_join(replacement_lines(F.col("replacements")), "\n").alias("log"))


# Sequences -------------------------------------------------------------------


@_query(f"""SELECT conv_id, turn, pos, token, lag(token) OVER w AS before, lead(token) OVER w AS after FROM (
  SELECT conv_id, turn, unnest({_split("text")}) AS token, generate_subscripts({_split("text")}, 1) - 1 AS pos FROM conversations) WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos)""")
def token_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN1 D8: tokens with their neighbours."""
    rows = joins.tokens(_turns(spark, sf_dir), "text", "conv_id", "turn")
    return joins.neighbours(rows, "conv_id", "turn").select("conv_id", "turn", *_long("pos"), "token", "before", "after")


@_query(f"""SELECT conv_id, turn, greatest(len({_split("text")}) - 2, 0) AS frames, CASE WHEN len({_split("text")}) >= 3 THEN array_to_string({_split("text")}[1:3], ' ') ELSE '' END AS first_frame FROM conversations""")
def token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN2: runs of three tokens."""
    f = windows.frames(words(F.col("text")))
    return _turns(spark, sf_dir).select("conv_id", "turn", F.size(f).cast("long").alias("frames"), F.coalesce(F.array_join(F.get(f, F.lit(0)), " "), F.lit("")).alias("first_frame"))


@_query("SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS r FROM conversations) WHERE r = 1")
def longest_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN3: the first of the longest turns of each conversation."""
    rows = _turns(spark, sf_dir).select("conv_id", "turn", "text").withColumn("score", F.length("text"))
    return windows.first_best(rows, "score", "turn", "conv_id").select("conv_id", "turn", "text")


@_query(f"SELECT conv_id, turn, md5(array_to_string(list_filter(ws, lambda w, i: i = 1 OR w <> ws[i - 1]), ' ')) AS once FROM (SELECT conv_id, turn, {_split('text')} AS ws FROM conversations)")
def without_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN4: neighbouring equal tokens once."""
    return _turns(spark, sf_dir).select("conv_id", "turn", F.md5(F.array_join(windows.without_runs(words(F.col("text"))), " ").cast("binary")).alias("once"))


@_query("SELECT doc_id, (rn - 1) // 10 AS batch, rn + 100 AS id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents)")
def numbered_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN5 ORD1: row numbers, batches and ids without a single-task window."""
    from ..sources.readers import in_order

    rows = windows.batches(in_order(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id"), "n", 10, 100)
    return rows.select("doc_id", *_long("batch", "id"))


@_query("""WITH c AS (SELECT item_id AS epoch, length(text)::DOUBLE AS val_loss FROM benchmark), i AS (SELECT *, coalesce(val_loss < min(val_loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved, min(val_loss) OVER (ORDER BY epoch) AS best FROM c),
  w AS (SELECT *, epoch - max(CASE WHEN improved THEN epoch END) OVER (ORDER BY epoch) AS waited FROM i)
  SELECT epoch, val_loss, improved, best, waited, coalesce(bool_or(waited > 3) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped FROM w""")
def early_stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN6: best so far and patience over a curve."""
    curve = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("epoch"), F.length("text").cast("double").alias("val_loss"))
    return windows.early_stop(curve).select("epoch", "val_loss", "improved", "best", "waited", "stopped")


@_query("SELECT conv_id, turn, round(avg(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 6) AS mean_so_far FROM conversations")
def running_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG15: the mean so far."""
    rows = _turns(spark, sf_dir).withColumn("n", F.length("text"))
    return aggregates.running_mean(rows, "n", "turn", "conv_id").select("conv_id", "turn", F.round("mean_so_far", 6).alias("mean_so_far"))


@_query("SELECT doc_id, round(avg(length(text)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING), 6) AS mean_so_far, max(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS longest_before FROM documents")
def running_means_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG15: one global sequence over all documents, by a prefix scan."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n"))
    means = aggregates.running_mean(rows, "n", "doc_id")
    both = prefix_scan(means, ["doc_id"], exclusive=True, longest_before=("max", F.col("n")))
    return both.select("doc_id", F.round("mean_so_far", 6).alias("mean_so_far"), "longest_before")


@_query("""WITH c AS (SELECT doc_id, length(text) AS n FROM documents), i AS (SELECT *, coalesce(n < min(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved, min(n) OVER (ORDER BY doc_id) AS best FROM c),
  w AS (SELECT *, doc_id - max(CASE WHEN improved THEN doc_id END) OVER (ORDER BY doc_id) AS waited FROM i)
  SELECT doc_id, improved, best, waited, coalesce(bool_or(waited > 40) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped FROM w""")
def early_stopping_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN6: patience over one curve that is a whole table."""
    curve = _table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n"))
    return windows.early_stop(curve, 40, "n", "doc_id").select("doc_id", "improved", "best", "waited", "stopped")


#: Latin letters, and letters of other scripts that stand in for them (``folded_scripts``).
_SCRIPTS = {
    "greek": ("abgdezqiklmncoprstufhyw", "αβγδεζθικλμνξοπρστυφχψω"),
    "cyrillic": ("abvgdejziklmnoprstufhcyqwx", "абвгдежзиклмнопрстуфхцычшщ"),
    "devanagari": ("kgcjtdnpbmyrlvshaiue", "कगचजतदनपबमयरलवसहअइउए"),
    "kana": ("aiueokstnhmr", "アイウエオかさタなはマら"),
    "hangul": ("abcdefghij", "한국어가나다라마바사"),
    "hebrew": ("bglmnqrstz", "בגלמנקרשתז"),
    "arabic": ("btjdrszfklmnwy", "بتجدرسزفكلمنوي"),
    "georgian": ("abgdevztklmn", "აბგდევზტკლმნ"),
    "wide": ("abcdefghijklmnopqrstuvwxyz", "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ"),
    "bold": ("abcdefghijklmnopqrstuvwxyz", "".join(map(chr, range(0x1D41A, 0x1D434)))),
    "marked": ("acdeghilnorstuyz", "ạčđệğħįłŋőŕşţůÿž"),
    "signs": (".,abcd", "…„©½№ﬃ"),
}
#: What those letters must become, written out for the other engine (fixed values).
_IN_ASCII = {
    "greek": "a:a b:b g:g d:d e:e z:z q:th i:i k:k l:l m:m n:n c:x o:o p:p r:r s:s t:t u:u f:ph h:kh y:ps w:o",
    "cyrillic": "a:a b:b v:v g:g d:d e:e j:zh z:z i:i k:k l:l m:m n:n o:o p:p r:r s:s t:t u:u f:f h:kh c:ts y:y q:ch w:sh x:shch",
    "devanagari": "k:k g:g c:c j:j t:t d:d n:n p:p b:b m:m y:y r:r l:l v:v s:s h:h a:a i:i u:u e:e",
    "kana": "a:a i:i u:u e:e o:o k:ka s:sa t:ta n:na h:ha m:ma r:ra",
    "hangul": "a:han b:gug c:eo d:ga e:na f:da g:ra h:ma i:ba j:sa",
    "hebrew": "b:b g:g l:l m:m n:n q:q r:r s:sh t:t z:z",
    "arabic": "b:b t:t j:j d:d r:r s:s z:z f:f k:k l:l m:m n:n w:w y:y",
    "georgian": "a:a b:b g:g d:d e:e v:v z:z t:t k:k l:l m:m n:n",
    "wide": "",
    "bold": "",
    "marked": "a:a c:c d:d e:e g:g h:h i:i l:l n:ng o:o r:r s:s t:t u:u y:y z:z",
    "signs": ".:... ,:,, a:(c) b:1/2 c:No d:ffi",
}


def _in_ascii(script: str) -> str:
    values = dict(x.split(":", 1) for x in _IN_ASCII[script].split())
    return f"array_to_string(list_transform(string_split(lower(text), ''), lambda c: coalesce({_map(values or {'a': 'a'})}[c], c)), '')"


@_query("SELECT conv_id, turn, script, md5(" + _folded("folded") + ") AS folded FROM (" + " UNION ALL ".join(f"SELECT conv_id, turn, '{s}' AS script, {_in_ascii(s)} AS folded FROM conversations" for s in _IN_ASCII) + ")")
def folded_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC8: all turns with their letters in eleven scripts and styles, folded back to ASCII."""
    lower = F.lower("text")
    texts = F.array(*[F.struct(F.lit(s).alias("script"), F.translate(lower, *pair).alias("t")) for s, pair in _SCRIPTS.items()])
    each = _turns(spark, sf_dir).select("conv_id", "turn", F.explode(texts).alias("x"))
    return each.select("conv_id", "turn", "x.script", F.md5(fold_to_ascii(F.col("x.t")).cast("binary")).alias("folded"))


def _feistel_sql(x: str, a: int, b: int, rounds: int, seed: str) -> str:
    """One pass of the permutation over a + b bits: halves take turns to be changed by a hash of the other."""
    left, right = f"({x} >> {b})", f"({x} & {(1 << b) - 1})"
    hashed = lambda k, v: f"('0x' || substr(md5('{seed}:{k}:' || ({v})), 1, 8))::BIGINT"
    made = f"SELECT {left} AS l, {right} AS r"
    for k in range(rounds):
        made = f"SELECT xor(l, {hashed(k, 'r')} & {(1 << a) - 1}) AS l, r FROM ({made})" if k % 2 == 0 else f"SELECT l, xor(r, {hashed(k, 'l')} & {(1 << b) - 1}) AS r FROM ({made})"
    return f"(SELECT (l << {b}) | r FROM ({made}))"


def _shuffle_sql() -> str:
    """The permutation walks until it is inside the table; here each number of bits that a table may need is tried by its size."""
    bits = range(2, 18)
    step = "CASE " + " ".join(f"WHEN bits = {n} THEN {_feistel_sql('x', n // 2, n - n // 2, 6, '27')}" for n in bits) + " END"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n, (SELECT count(*) FROM documents) AS size FROM documents),
      s AS (SELECT doc_id, n, size, greatest(2, ceil(log2(size)))::INT AS bits FROM d),
      w(doc_id, x, size, bits, k) AS (SELECT doc_id, n, size, bits, 0 FROM s UNION ALL SELECT doc_id, {step}, size, bits, k + 1 FROM w WHERE k = 0 OR x >= size)
      SELECT doc_id, x AS place FROM w WHERE k > 0 AND x < size"""


@_query(_shuffle_sql())
def shuffled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMP3: the place of each document in a full shuffle, by a keyed permutation of row numbers."""
    return samples.shuffled(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@_query(f"""WITH {_WORDS}, {_GROUPS}, w AS (SELECT code, base_word, n, unnest(variants) AS v, generate_subscripts(variants, 1) - 1 AS i FROM groups)
  SELECT code, i // 4 AS chunk, base_word, n, array_to_string(list(v ORDER BY i), ' ') AS variants FROM w GROUP BY code, i // 4, base_word, n""")
def variant_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG5 JN6: phonetic groups as sorted chunks of at most four variants, whatever a group's size."""
    found = dictionary.variant_postings(_table(spark, sf_dir, "documents"), "text", _vocabulary(spark), chunk=4)
    return found.select("code", *_long("chunk"), "base_word", "n", F.array_join("variants", " ").alias("variants"))


@_query("""WITH c AS (SELECT conv_id, turn, length(text)::BIGINT AS chars FROM conversations),
  b AS (SELECT *, min(chars) OVER (PARTITION BY conv_id ORDER BY turn) AS best, coalesce(chars < min(chars) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM c),
  w AS (SELECT *, r - max(CASE WHEN better THEN r END) OVER (PARTITION BY conv_id ORDER BY turn) AS waited FROM b)
  SELECT conv_id, turn, chars, best::DOUBLE AS best, waited, coalesce(bool_or(waited > 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped FROM w""")
def patience_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.12: a table function over parts of a table, from SQL alone."""
    tables.register(ship(spark))
    return spark.sql(f"SELECT * FROM patience(TABLE(SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS chars FROM parquet.`{sf_dir}/conversations.parquet`) PARTITION BY conv_id ORDER BY (turn), 'chars', 1)")


@_query(f"""WITH {_LINES} SELECT doc_id, line_no, count(*) AS chunks, max(length(chunk))::BIGINT AS longest, md5(string_agg(chunk, '|' ORDER BY n)) AS joined FROM (
  SELECT doc_id, line_no, unnest(cs) AS chunk, generate_subscripts(cs, 1) AS n FROM (SELECT doc_id, line_no, CASE WHEN length(line) <= 125 THEN [line] ELSE string_split(list_reduce(list_prepend('', {_split("line")}), lambda a, w: CASE
    WHEN a = '' THEN w WHEN length(split_part(a, chr(1), len(string_split(a, chr(1))))) + 1 + length(w) <= 125 THEN a || ' ' || w ELSE a || chr(1) || w END), chr(1)) END AS cs FROM lines)) GROUP BY ALL""")
def chunks_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.12 SC15: chunks of every line by a lateral table function."""
    tables.register(ship(spark))
    lines = _lines(spark, sf_dir).select("doc_id", *_long("line_no"), "line")
    return spark.sql("SELECT doc_id, line_no, count(*) AS chunks, CAST(max(length(chunk)) AS BIGINT) AS longest, md5(CAST(array_join(transform(array_sort(collect_list(struct(n, chunk))), x -> x.chunk), '|') AS BINARY)) AS joined FROM {lines}, LATERAL text_chunks(line, 125) GROUP BY doc_id, line_no", lines=lines)


@_query()
def word_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOPK1: vectors of hashed subwords trained on all documents, and the five nearest words of every hundredth word by its hash, among all words."""
    texts = kept(_table(spark, sf_dir, "documents").select(F.transform(corpus_words(F.col("text")), F.lower).alias("words")), "texts")
    table = vectors.train(texts, epochs=1, partitions=48)
    found = kept(vectors.word_vectors(texts.select(F.explode("words").alias("word")).distinct(), table), "vectors")
    asked = found.where(F.pmod(F.xxhash64("word"), F.lit(100)) == 0)
    fitted = vectors.centroids(found, 512, id_col="word")
    near = vectors.nearest_by_lists(found, asked, fitted, 5, 16, "word")
    return near.select(F.col("query").alias("word"), F.col("id").alias("neighbour"), F.round("cosine", 4).alias("cosine"))


@_query()
def indexed_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOPK1: the five nearest vectors of every vector whose id is divisible by 100, by inverted lists over all vectors."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    fitted = vectors.centroids(rows, 64, id_col="vec_id", vector_col="embedding")
    near = vectors.nearest_by_lists(rows, rows.where("vec_id % 100 = 0"), fitted, 5, 40, "vec_id", "embedding")
    return near.select(F.col("query").cast("long").alias("vec_id"), F.col("id").cast("long").alias("near_id"), F.round("cosine", 6).alias("cosine"))


@_query(f"""WITH w AS (SELECT conv_id, turn, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM (SELECT conv_id, turn, list_filter({_split("lower(text)")}, lambda x: regexp_matches(x, '^[a-z]+$')) AS ws FROM conversations))
  SELECT conv_id, turn, pos, word, coalesce(MAP {{'school': 'स्कुल'}}[word], deva) AS devanagari FROM (
    SELECT *, {_deva("sound")} AS deva FROM (SELECT *, {_english_sound("word")} AS sound FROM w))""")
def english_pairs_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC27: the words of each turn paired with their Devanagari."""
    found = F.filter(words(F.lower("text")), lambda w: w.rlike("^[a-z]+$"))
    rows = _turns(spark, sf_dir).select("conv_id", "turn", F.posexplode(english_pairs(found)).alias("pos", "pair"))
    return rows.select("conv_id", "turn", *_long("pos"), "pair.word", "pair.devanagari")


@_query(f"""WITH w AS (SELECT conv_id, turn, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT conv_id, turn, list_concat({_split("text")}, [turn::VARCHAR, 'Ko', 'lai.', 'kolai', translate(turn::VARCHAR, '0123456789', '०१२३४५६७८९') || 'x']) AS ws FROM conversations))
  SELECT conv_id, turn, pos, lower(regexp_replace(word, '[^A-Za-z0-9\\x{{0900}}-\\x{{097F}}'']+', '', 'g')) IN ('ma', 'maa', 'le', 'ko', 'lai', 'sanga', 'bata', 'pachi', 'samma', 'bhitra', 'ta', 'nai') AS marker, regexp_matches(word, '^[0-9]+$') AS number, regexp_matches(word, '[०-९]') AS devanagari_digit FROM w""")
def word_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT11: markers, numbers and Devanagari digits among the words of each turn and some of its number."""
    number = F.col("turn").cast("string")
    more = F.array(number, F.lit("Ko"), F.lit("lai."), F.lit("kolai"), F.concat(devanagari_digits(number), F.lit("x")))
    rows = _turns(spark, sf_dir).select("conv_id", "turn", F.posexplode(F.concat(words(F.col("text")), more)).alias("pos", "w"))
    w = F.col("w")
    return rows.select("conv_id", "turn", (F.col("pos") + 1).cast("long").alias("pos"), filters.is_marker(w).alias("marker"), filters.is_roman_number(w).alias("number"), filters.has_devanagari_digit(w).alias("devanagari_digit"))


# Metrics ---------------------------------------------------------------------


def _eval_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(role, n, ref, hyp): whole turns against their rule-based form."""
    return _turns(spark, sf_dir).select("role", (F.col("conv_id") * 1000 + F.col("turn")).alias("n"), F.col("text").alias("ref"), rule_text(F.col("text")).alias("hyp"))


_PAIRS = f"{_RULED_TURNS}, pairs AS (SELECT role, conv_id * 1000 + turn AS n, text AS ref, t AS hyp FROM ruled_turns)"


def _distance(a: str, b: str) -> str:
    """Edit distance in characters; the other engine counts bytes, so a pair's other characters become unused control characters."""
    other = f"array_to_string(list_sort(list_distinct(regexp_extract_all({a} || {b}, '[^\\x00-\\x7F]'))), '')"
    low = " || ".join(f"chr({i})" for i in [*range(1, 9), *range(14, 32)])
    return f"levenshtein(translate({a}, {other}, {low}), translate({b}, {other}, {low}))"


def _word_distances(pairs: str) -> str:
    """CTEs that end in worded (n, h, r) and word_errors (n, errors), row by row of the distance table."""
    return f"""worded AS (SELECT n, {_split("hyp")} AS h, {_split("ref")} AS r FROM {pairs}),
  dp(n, i, row) AS (SELECT n, 0, range(0, len(r) + 1) FROM worded UNION ALL
    SELECT n, i + 1, list(least_so_far + j ORDER BY j) FROM (
      SELECT n, i, j, min(t - j) OVER (PARTITION BY n ORDER BY j) AS least_so_far FROM (
        SELECT dp.n, i, j, CASE WHEN j = 0 THEN i + 1 ELSE least(row[j + 1] + 1, row[j] + (h[i + 1] <> r[j])::INT) END AS t FROM dp JOIN worded USING (n), LATERAL (SELECT unnest(range(0, len(r) + 1)) AS j) WHERE i < len(h)))
    GROUP BY n, i),
  word_errors AS (SELECT n, row[-1] AS errors FROM dp JOIN worded USING (n) WHERE i = len(h))"""


_BLEU = """grams AS (SELECT n, k, side, substr(x, p, k) AS gram, count(*) AS c FROM (
    SELECT n, k, side, x, unnest(range(1, length(x) - k + 2)) AS p FROM (SELECT n, 'h' AS side, hyp AS x FROM pairs UNION ALL SELECT n, 'r', ref FROM pairs), (SELECT unnest([1, 2, 3, 4]) AS k) WHERE length(x) >= k) GROUP BY ALL),
  hits AS (SELECT n, k, sum(least(a.c, b.c)) AS m FROM (FROM grams WHERE side = 'h') a JOIN (FROM grams WHERE side = 'r') b USING (n, k, gram) GROUP BY n, k),
  orders AS (SELECT n, k, coalesce(m, 0)::DOUBLE AS m, greatest(length(hyp) - k + 1, 1)::DOUBLE AS d, length(hyp) AS lp, length(ref) AS lt, sum((coalesce(m, 0) = 0)::INT) OVER (PARTITION BY n ORDER BY k) AS empty FROM pairs CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k) LEFT JOIN hits USING (n, k)),
  terms AS (SELECT *, ln(CASE WHEN m = 0 THEN 0.1 ELSE m END / d) AS t1, CASE WHEN m > 0 THEN ln(m / d) WHEN lp > 1 THEN ln(1 / (2.0 ** empty * 5.0 / ln(lp) * d)) ELSE -1e300 END AS t4 FROM orders),
  bleu AS (SELECT n, CASE WHEN bool_or(k = 1 AND m = 0) THEN 0.0 ELSE min(CASE WHEN lp > lt THEN 1.0 ELSE exp(1 - lt / lp) END) * exp(sum(t1) / 4) END AS bleu1,
    CASE WHEN bool_or(k = 1 AND m = 0) THEN 0.0 ELSE min(CASE WHEN lp > lt THEN 1.0 ELSE exp(1 - lt / lp) END) * exp(sum(t4) / 4) END AS bleu4 FROM terms GROUP BY n)"""


@_query(f"WITH {_PAIRS}, e AS (SELECT n, ref, {_distance('hyp', 'ref')} AS errors FROM pairs) SELECT n, errors, round(errors::DOUBLE / greatest(length(ref), 1), 9) AS cer FROM e")
def character_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC17: character errors of each pair."""
    p = aggregates.settled(_eval_pairs(spark, sf_dir), "hyp").select("n", "ref", char_errors(F.col("hyp"), F.col("ref")).cast("long").alias("errors"))
    return p.select("n", "errors", F.round(cer_of(F.col("errors"), F.col("ref")), 9).alias("cer"))


@_query(f"WITH RECURSIVE {_PAIRS}, {_word_distances('pairs')} SELECT n, errors, len(list_filter(list_zip(h, r), lambda z: z[1] = z[2])) AS in_place FROM worded JOIN word_errors USING (n)")
def word_errors_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC18 AGG10: word errors and words in place."""
    p = _eval_pairs(spark, sf_dir)
    return p.select("n", word_errors(F.col("hyp"), F.col("ref")).cast("long").alias("errors"), words_in_place(F.col("hyp"), F.col("ref")).cast("long").alias("in_place"))


@_query(f"""WITH {_PAIRS}, e AS (SELECT *, {_distance('hyp', 'ref')} AS errors FROM pairs) SELECT role, round(sum(errors)::DOUBLE / sum(greatest(length(ref), 1)), 9) AS cer, round(avg(errors), 9) AS mean_edit_distance,
  round(sum(len(list_filter(list_zip({_split("hyp")}, {_split("ref")}), lambda z: z[1] = z[2])))::DOUBLE / sum(len({_split("ref")})), 9) AS word_accuracy FROM e GROUP BY role""")
def micro_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG9 AGG10 AGG11: errors over lengths, summed by role."""
    m = aggregates.micro_scores(_eval_pairs(spark, sf_dir), "role")
    return m.select("role", *[F.round(c, 9).alias(c) for c in ("cer", "mean_edit_distance", "word_accuracy")])


@_query(f"""WITH RECURSIVE lines AS (SELECT item_id * 2 + k AS n, k, item_id, text AS ref, CASE WHEN k = 0 THEN {_ruled_of("text")} ELSE {_strip(f"lower(translate(text, '{_PUNCT}', ''))")} END AS hyp FROM benchmark, (SELECT unnest([0, 1]) AS k)),
  bleu_of AS (WITH pairs AS (SELECT n, ref, hyp FROM lines), {_BLEU} SELECT n % 2 AS k, avg(bleu4) AS bleu FROM bleu GROUP BY 1),
  joined AS (SELECT k AS n, string_agg(ref, ' ' ORDER BY item_id) AS ref, string_agg(hyp, ' ' ORDER BY item_id) AS hyp FROM lines GROUP BY k), {_word_distances('joined')}
  SELECT CASE j.n WHEN 0 THEN 'rules' ELSE 'plain' END AS config, round({_distance('hyp', 'ref')}::DOUBLE / length(ref), 9) AS cer, round(errors::DOUBLE / len(r), 9) AS wer, round(bleu, 9) AS bleu
  FROM joined j JOIN worded w ON j.n = w.n JOIN word_errors e ON j.n = e.n JOIN bleu_of b ON b.k = j.n""")
def evaluation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG8 AGG12 JN3 D16: joined CER and WER and mean BLEU of the benchmark against its rule-based form."""
    items = _table(spark, sf_dir, "benchmark")
    ref = items.select(F.col("item_id").alias("n"), F.col("text").alias("value"))
    out = joins.with_configs(items, [("rules",), ("plain",)], "config").select("config", F.col("item_id").alias("n"), F.when(F.col("config") == "rules", rule_text(F.col("text"))).otherwise(plain_lower(F.col("text"))).alias("value"))
    return evaluation.evaluate(ref, out, "config").select("config", *[F.round(c, 9).alias(c) for c in ("cer", "wer", "bleu")])


@_query(f"WITH {_PAIRS}, {_BLEU} SELECT n, round(bleu1, 9) AS bleu1, round(bleu4, 9) AS bleu4 FROM bleu UNION ALL SELECT n, 0.0, 0.0 FROM pairs ANTI JOIN bleu USING (n)")
def bleu_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC19: character BLEU of whole turns with both smoothings."""
    p = _eval_pairs(spark, sf_dir).withColumn("matched", matched_ngrams(F.col("hyp"), F.col("ref")))
    return p.select("n", *[F.round(char_bleu(F.col("hyp"), F.col("ref"), m, F.col("matched")), 9).alias(f"bleu{m}") for m in (1, 4)])


@_query()
def similar_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC16 SC28 FLT7 FLT10: matching ratio of each block's words to its first."""
    pairs = block_pairs(spark, sf_dir)
    return filters.unlike(pairs, "head", "other", 0.5).select("code", "head", "other", F.round("ratio", 9).alias("ratio"))


_METRICS = """m AS (SELECT 'm' || (doc_id % 5) AS model, source AS config, min(doc_id) AS ord, avg(n_chars)::DOUBLE AS cer, max(n_chars)::DOUBLE AS wer, min(n_chars)::DOUBLE AS bleu FROM documents GROUP BY 1, 2)"""


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.groupBy(F.concat(F.lit("m"), F.col("doc_id") % 5).alias("model"), F.col("source").alias("config")).agg(F.min("doc_id").alias("ord"), F.avg("n_chars").alias("cer"), F.max("n_chars").cast("double").alias("wer"), F.min("n_chars").cast("double").alias("bleu"))


@_query(f"WITH {_METRICS} SELECT model, arg_min(config, (cer, ord)) AS best_cer, arg_min(config, (wer, ord)) AS best_wer, arg_min(config, (-bleu, ord)) AS best_bleu FROM m GROUP BY model")
def best_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG13: the best configuration in each metric."""
    return aggregates.best_by_metric(_metrics(spark, sf_dir), "config", "ord", "model")


@_query(f"WITH {_METRICS} SELECT model, arg_min(config, (cer, ord)) AS config, round(min(cer), 9) AS cer, min(wer) AS wer, max(bleu) AS bleu FROM m GROUP BY model")
def best_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG14 ORD4 ORD5: each model's best configuration, ranked."""
    return aggregates.best_config_then_model(_metrics(spark, sf_dir)).select("model", "config", F.round("cer", 9).alias("cer"), "wer", "bleu")


@_query("""SELECT item_id, round(CASE WHEN r BETWEEN 0.5 AND 2.25 THEN greatest(0.0, 1 - abs(r - 1) / 1.25) ELSE 0.0 END, 9) AS score, r BETWEEN 0.5 AND 2.25 AS fits, round(exp(-abs(item_id % 7 - item_id % 3)::DOUBLE / 3), 9) AS place,
  CASE kind WHEN 'backward' THEN greatest(0, item_id % 5 - 2) WHEN 'both' THEN greatest(0, item_id % 5 - 2) ELSE item_id % 5 END::INT AS low, CASE kind WHEN 'same' THEN item_id % 5 ELSE least(6, item_id % 5 + 2) END::INT AS high FROM (
  SELECT a.item_id, ['same', 'forward', 'both'][a.item_id % 3 + 1] AS kind, greatest(length(regexp_replace(b.text, '[^A-Za-z0-9\\x{0900}-\\x{097F}'']+', '', 'g')), 1)::DOUBLE / greatest(length(regexp_replace(a.text, '[^A-Za-z0-9\\x{0900}-\\x{097F}'']+', '', 'g')), 1) AS r FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)""")
def length_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC21 FLT8 SC46: length scores of each item and the next, place scores and window bounds."""
    items = _table(spark, sf_dir, "benchmark")
    rows = items.join(items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("next")), "item_id")
    s, t, i = F.col("text"), F.col("next"), F.col("item_id")
    bounds = F.when(i % 3 == 0, window_bounds("same", i % 5, F.lit(7), F.lit(2))).when(i % 3 == 1, window_bounds("forward", i % 5, F.lit(7), F.lit(2))).otherwise(window_bounds("both", i % 5, F.lit(7), F.lit(2)))
    scored = rows.select("item_id", F.round(length_score(s, t), 9).alias("score"), filters.length_fits(s, t).alias("fits"), F.round(position_score(i % 3, i % 7, F.lit(5), F.lit(7)), 9).alias("place"), bounds.alias("b"))
    return scored.select("item_id", "score", "fits", "place", "b.low", "b.high")


# Samples, splits and sets ----------------------------------------------------


@_query("SELECT doc_id FROM documents ORDER BY md5('27:' || doc_id), doc_id LIMIT 200")
def sampled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMP1 SMP2 LIM2: a uniform sample of exactly 200 rows."""
    return samples.sample_rows(_table(spark, sf_dir, "documents").select("doc_id"), 200, "doc_id")


@_query("""WITH o AS (SELECT doc_id, length(text) AS n, row_number() OVER (ORDER BY md5('27:' || doc_id) DESC, doc_id DESC) AS r FROM documents) SELECT doc_id, CASE WHEN r <= 200 OR n > 300 THEN 'val' ELSE 'train' END AS split FROM o""")
def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SPL1 SMP3 FLT4: hash-ordered holdout, over-long rows with it."""
    return samples.split_rows(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", 200, 300, ("text",)).select("doc_id", "split")


@_query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents) WHERE n > 100 AND n <= 250")
def row_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIM1 LIM3 ORD1: a slice of numbered rows."""
    from ..sources.readers import in_order

    return samples.rows_between(in_order(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id"), 100, 250).select("doc_id")


@_query("""SELECT vec_id, round(c, 6) AS cosine FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]) AS c FROM embeddings) ORDER BY c DESC, vec_id LIMIT 5""")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOPK1 D20: the five vectors nearest to the first."""
    vectors = _table(spark, sf_dir, "embeddings")
    query = vectors.where("vec_id = 0").first()["embedding"]
    return samples.nearest(vectors, list(query)).select("vec_id", F.round("cosine", 6).alias("cosine"))


@_query("SELECT text FROM conversations UNION SELECT text FROM benchmark")
def merged_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET1 SET2 AGG4 SNK8: two corpora as one, each text once."""
    return sets.merged_distinct([_turns(spark, sf_dir).select("text"), _table(spark, sf_dir, "benchmark").select("text")])


@_query("SELECT id, text FROM (SELECT conv_id AS id, text, row_number() OVER (PARTITION BY conv_id ORDER BY src, turn) AS r FROM (SELECT 0 AS src, * FROM conversations WHERE role = 'user' UNION ALL SELECT 1 AS src, * FROM conversations)) WHERE r = 1 ORDER BY id")
def first_of_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET1 SET3 ORD1: the earlier file's row of each id."""
    turns = _turns(spark, sf_dir)
    both = sets.stacked([turns.where("role = 'user'").withColumn("src", F.lit(0)), turns.withColumn("src", F.lit(1))]).withColumnRenamed("conv_id", "id")
    return sets.first_of_key(both.select("id", "turn", "src", "text"), "id", "src", "turn").select("id", "text").orderBy("id")


@_query(f"WITH {_WORDS} SELECT word FROM words WHERE length(word) > 1 ORDER BY word")
def sorted_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ORD2 FLT6: distinct words in code-point order."""
    return filters.longer_than(_words(spark, sf_dir), "word", 1).select("word").orderBy("word")


@_query(f"WITH {_WORDS}, d AS (SELECT DISTINCT unnest(regexp_extract_all({_deva('word')}, '[\\x{{0900}}-\\x{{097F}}]+')) AS word FROM words) SELECT word FROM d WHERE length(word) > 1 ORDER BY word")
def devanagari_word_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC42 FLT6 AGG3 SNK9: the different Devanagari words."""
    return dictionary.devanagari_words(_words(spark, sf_dir).select(transliterate(F.col("word")).alias("line")), "line")


def _dice(*parts: str) -> str:
    return "('0x' || substr(md5(" + " || ':' || ".join(parts) + "), 1, 8))::BIGINT"


@_query(f"""WITH {_WORDS}, {_GROUPS}, cl AS (SELECT unnest(variants) AS word, variants AS cluster FROM groups),
  t AS (SELECT item_id AS id, unnest({_split("text")}) AS token, generate_subscripts({_split("text")}, 1) - 1 AS pos FROM benchmark),
  e AS (SELECT t.*, cluster, v FROM t LEFT JOIN cl ON lower(token) = word, (SELECT unnest([1, 2, 3]) AS v)),
  s AS (SELECT *, CASE WHEN cluster IS NOT NULL AND {_dice("id::VARCHAR", "v::VARCHAR", "pos::VARCHAR", "'swap'")} < {int(0.7 * 2**32)} THEN cluster[{_dice("id::VARCHAR", "v::VARCHAR", "pos::VARCHAR", "'pick'")} % len(cluster) + 1] ELSE token END AS w FROM e)
  SELECT item_id AS id, 0 AS variation, text AS sentence FROM benchmark UNION ALL SELECT id, v AS variation, string_agg(w, ' ' ORDER BY pos) AS sentence FROM s GROUP BY id, v""")
def augmented_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC41 JN5 D6 SRC11: each sentence and three variations from the clusters."""
    known, members = dictionary.members_of(_groups(spark, sf_dir))
    rows = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return dictionary.augmented_by_members(rows, "text", known, members)


# Pairs, edits and alignment --------------------------------------------------


@_query("""SELECT doc_id, i FROM (SELECT doc_id, unnest(list_filter([CASE WHEN r < 0.3 OR r > 3 THEN 'length-ratio:' || format('{:,.2f}', r) END], lambda x: x IS NOT NULL)) AS i FROM (
  SELECT doc_id, CASE WHEN length(lang || source) = 0 THEN 0.0 ELSE length(text)::DOUBLE / length(lang || source) END AS r FROM documents))""")
def pair_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT9: odd pairs and why."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.explode(filters.pair_issues(F.col("text"), F.concat("lang", "source"))).alias("i"))
    return rows


@_query("""WITH r AS (SELECT doc_id AS row, lang AS romanized, source AS devanagari FROM documents), e AS (SELECT doc_id AS row, doc_id AS seq, 'q' || quality AS nr, 't' || toxic AS nd FROM labels UNION ALL SELECT doc_id, doc_id + 1000000, 'second', 't' || toxic FROM labels WHERE toxic = 1),
  n AS (SELECT row, arg_max(nr, seq) AS nr, arg_max(nd, seq) AS nd FROM e GROUP BY row) SELECT row, coalesce(nr, romanized) AS romanized, coalesce(nd, devanagari) AS devanagari FROM r LEFT JOIN n USING (row)""")
def edited_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN9 D17: the newest edit of each row applied."""
    return joins.overlay_edits(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row"), F.col("lang").alias("romanized"), F.col("source").alias("devanagari")), _edits(spark, sf_dir))


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    first = labels.select(F.col("doc_id").alias("row"), F.col("doc_id").alias("seq"), F.concat(F.lit("q"), "quality").alias("new_romanized"), F.concat(F.lit("t"), "toxic").alias("new_devanagari"))
    second = labels.where("toxic = 1").select(F.col("doc_id").alias("row"), (F.col("doc_id") + 1000000).alias("seq"), F.lit("second").alias("new_romanized"), F.concat(F.lit("t"), "toxic").alias("new_devanagari"))
    return first.unionByName(second)


@_query("""WITH e AS (SELECT doc_id AS row, doc_id AS seq FROM labels UNION ALL SELECT doc_id, doc_id + 1000000 FROM labels WHERE toxic = 1)
  SELECT count(DISTINCT row) AS rows_edited, count(*) AS edits, (SELECT string_agg(row::VARCHAR, ',' ORDER BY seq DESC) FROM (SELECT * FROM e ORDER BY seq DESC LIMIT 5)) AS newest FROM e""")
def edit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG16: edited rows, edits and the newest five."""
    return aggregates.edit_summary(_edits(spark, sf_dir)).select("rows_edited", "edits", F.array_join(F.transform("newest", lambda x: x.cast("string")), ",").alias("newest"))


@_query("SELECT a.conv_id, a.turn AS n, a.text AS hyp, b.text AS ref FROM conversations a JOIN conversations b ON a.turn = b.turn AND b.conv_id = 0")
def aligned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN3 SRC2: lines joined by number, up to the shorter side's end."""
    turns = _turns(spark, sf_dir).withColumnsRenamed({"turn": "n", "text": "value"})
    return joins.align_lines(turns.where("conv_id = 0").select("n", "value"), turns.select("conv_id", "n", "value")).select("conv_id", "n", "hyp", "ref")


@_query(f"""WITH z AS (SELECT conv_id, turn, unnest(list_zip({_split("text")}, {_split("role || ' x y z'")}, true)) AS z FROM conversations) SELECT conv_id, turn, z[1] AS "left", z[2] AS "right" FROM z""")
def zipped_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN4: arrays joined by place, up to the shorter one's end."""
    z = joins.zip_arrays(words(F.col("text")), words(F.concat("role", F.lit(" x y z"))))
    return _turns(spark, sf_dir).select("conv_id", "turn", F.explode(z).alias("z")).select("conv_id", "turn", "z.left", "z.right")


@_query(f"""WITH s AS (SELECT conv_id, turn, unnest({_split("text")}) AS token, generate_subscripts({_split("text")}, 1) - 1 AS pos, len({_split("text")}) AS n FROM conversations)
  SELECT s.conv_id, s.turn, s.pos AS source_pos, t.pos AS target_pos FROM s JOIN s t USING (conv_id, turn) WHERE t.pos BETWEEN greatest(0, s.pos - 1) AND least(t.n - 1, s.pos + 1)""")
def candidate_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN7: places searched for each word, as a band join within sentences."""
    rows = joins.tokens(_turns(spark, sf_dir).withColumn("n", F.size(words(F.col("text")))), "text", "conv_id", "turn", "n")
    return joins.candidate_places(rows.withColumnRenamed("n", "n_in"), rows.withColumnRenamed("n", "n_out"), "conv_id", "turn").select("conv_id", "turn", *_long("source_pos", "target_pos"))


@_query("""SELECT page_id, md5(regexp_replace(url, 'http\\S+|www\\S+|https\\S+', '', 'g')) AS rest, string_split(string_split(url, '@')[-1], '/')[1] AS channel FROM pages""")
def page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC6 SC45: URLs dropped, channel names cut out."""
    from ..functions.text import channel_name

    rest = F.regexp_replace("url", "http\\S+|www\\S+|https\\S+", "")
    return _table(spark, sf_dir, "pages").select("page_id", F.md5(rest.cast("binary")).alias("rest"), channel_name(F.col("url")).alias("channel"))


@_query()
def repaired_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC20 SC29 SC32 SC33 SC34 SC35 SC36 D9 D11: benchmark items transliterated and repaired."""
    items = _table(spark, sf_dir, "benchmark")
    pairs = items.select("item_id", F.col("text").alias("roman"), transliterate(F.lower("text")).alias("deva"))
    return repair(pairs, "roman", "deva", VOCABULARY).select("item_id", "text", F.size("replacements").cast("long").alias("replacements"))


@_query()
def earlier_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC46 AGG18 ORD6: what the earlier matchers choose for each English word of the benchmark items."""
    items = _table(spark, sf_dir, "benchmark")
    pairs = items.select("item_id", F.col("text").alias("roman"), transliterate(F.lower("text")).alias("deva"))
    return matched_words(pairs, "roman", "deva", VOCABULARY).select("item_id", "m.*")


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _FOUND.items()} | files.queries()


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items() if sql} | files.oracle_sql()
