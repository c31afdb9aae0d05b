"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seamcover.llm.chat import op9_chat
from seamcover.llm.decontamination import op8_decontamination
from seamcover.llm.language import op1_language_id
from seamcover.llm.licenses import op3_licenses
from seamcover.llm.pieces import op2_sentencepiece
from seamcover.llm.quality import POLICY, RULES, mask, op7_quality
from seamcover.llm.scoring import op5_lm_scores
from seamcover.llm.secrets import op10_secrets
from seamcover.llm.sharding import op6_sharding
from seamcover.llm.simhash import op4_simhash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_licenses": op3_licenses,
    "op4_simhash": op4_simhash,
    "op5_lm_scores": op5_lm_scores,
    "op6_sharding": op6_sharding,
    "op7_quality": op7_quality,
    "op8_decontamination": op8_decontamination,
    "op9_chat": op9_chat,
    "op10_secrets": op10_secrets,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_SPACED = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

_OP8 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_ALNUM} w FROM documents),
items AS (SELECT DISTINCT CAST(item_id AS VARCHAR) id, {_ALNUM} w FROM benchmark WHERE item_id IS NOT NULL),
win AS MATERIALIZED (
  SELECT DISTINCT id, least(len(w), 10) n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') s
  FROM items, unnest(range(1, greatest(len(w) - 10, 0) + 2)) r(i) WHERE len(w) > 0),
own AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') s FROM d, (SELECT DISTINCT n FROM win), unnest(range(1, len(w) - n + 2)) r(i)),
hit AS MATERIALIZED (SELECT doc_id, i, n, id FROM own JOIN win USING (n, s)),
places AS (SELECT doc_id, count(DISTINCT p) n_hit FROM hit, unnest(range(i, i + n)) r(p) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) n_items, string_agg(id, ',' ORDER BY id) s FROM (SELECT DISTINCT doc_id, id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(s, '')) items_sha256, n_hit IS NOT NULL contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

_BITS = " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(RULES.values()))
_OP7 = f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') t, {_SPACED} w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) l FROM documents),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) c FROM d, unnest(range(1, len(w) - 1)) r(i)),
again AS (SELECT doc_id, count(DISTINCT p) n FROM tri, unnest(range(i, i + 3)) r(p) WHERE c > 1 GROUP BY doc_id),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(length(array_to_string(w, '')) AS BIGINT) word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) n_dup_lines, coalesce(n, 0) n_repeat_words, len(l) n_lines,
    len(list_filter(w, lambda x: regexp_matches(x, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]'))) n_alpha_words, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) n_upper
  FROM d LEFT JOIN again USING (doc_id)),
b AS (SELECT *, CAST({_BITS} AS BIGINT) fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {mask("base")} <> 0 base_failed, fail_bits & {mask("base") | mask(POLICY)} = 0 kept, fail_bits FROM b
"""

#: The other operators hash with XXH64 or CRC-32, search by byte offsets or learn models, which SQL can't express here;
#: the tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op7_quality": _OP7, "op8_decontamination": _OP8}
