"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tablewash.llm.chat import END, LINE, NEXT, START

_SAID = "<|im_end|><|im_start|>assistant ok"

CHAT = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_SAID}' UNION ALL SELECT -1, 1, 'assistant', '{_SAID}'),
written AS (
  SELECT *, length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS text_chars,
    length(replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), chr(10), '{LINE}')) AS role_chars,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(text_chars + CASE WHEN before = role THEN {len(NEXT)} ELSE {len(START) + len(END) + 2} + role_chars END) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id
"""

QUALITY = r"""
WITH worded AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS whole,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT r, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS win
  FROM worded),
repeated AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
reach AS (SELECT r, least(8, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 8)) AS n FROM repeated),
covered AS (SELECT r, sum(n) AS n FROM reach GROUP BY r),
parts AS (
  SELECT *, array_to_string(w, '') AS bare,
    list_filter(string_split(whole, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM worded),
measured AS (
  SELECT doc_id, source, len(w) AS n_words, length(bare) AS word_chars,
    length(regexp_replace(bare, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
    CASE WHEN regexp_matches(bare, '[A-ZÀ-ÖØ-Þ]{2}') THEN length(regexp_replace(bare, '[^A-ZÀ-ÖØ-Þ]', '', 'g')) ELSE 0 END AS n_capitals
  FROM parts LEFT JOIN covered USING (r)),
ruled AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, 10 * n_symbols > n_words AS symbols,
    3 * n_dup_lines > n_lines AS dup_lines, 2 * n_capitals > word_chars AS capitals FROM measured),
counts AS (
  SELECT source, rule, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS f
  FROM (SELECT source, unnest(['symbols', 'dup_lines', 'capitals', 'any']) AS rule,
          unnest([symbols, dup_lines, capitals, base_failed OR symbols OR dup_lines OR capitals]) AS failed FROM ruled)
  GROUP BY source, rule),
corpus AS (
  SELECT rule, sum(f) / sum(n) AS p, sum(n) AS docs, count(*) AS hosts,
    (sum(f * f / n) - sum(n) * (sum(f) / sum(n)) ** 2) / (count(*) - 1) AS between_hosts, (sum(n) - sum(n * n) / sum(n)) / (count(*) - 1) AS mean_size
  FROM counts GROUP BY rule),
spread AS (SELECT *, CASE WHEN mean_size > 1 THEN greatest(0, (between_hosts - p * (1 - p)) / (mean_size - 1)) ELSE 0 END AS v FROM corpus),
prior AS (
  SELECT rule, p, CASE WHEN hosts < 2 OR p <= 0 OR p >= 1 THEN 1
    ELSE greatest(1, CASE WHEN v > 0 THEN least(docs, p * (1 - p) / v - 1) ELSE docs END) END AS weight FROM spread),
rates AS (SELECT source, rule, (f + p * weight) / (n + weight) AS rate FROM counts JOIN prior USING (rule)),
hosts AS (
  SELECT source, max(rate) FILTER (rule = 'symbols') AS symbols_rate, max(rate) FILTER (rule = 'dup_lines') AS dup_lines_rate,
    max(rate) FILTER (rule = 'capitals') AS capitals_rate, max(rate) FILTER (rule = 'any') AS any_rate FROM rates GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR symbols AND symbols_rate >= 0.05 OR dup_lines AND dup_lines_rate >= 0.05
       OR capitals AND capitals_rate >= 0.05 OR any_rate > 0.5) AS kept,
  round(any_rate, 9) AS host_rate
FROM ruled JOIN hosts ON ruled.source IS NOT DISTINCT FROM hosts.source
"""

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

RANKED = rf"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, {_TERMS} AS w FROM documents WHERE text IS NOT NULL),
corpus AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM docs WHERE len(w) > 0),
lengths AS (SELECT d, doc_id, 25 + (75 * len(w) * n_docs) // n_terms AS m FROM docs, corpus WHERE len(w) > 0),
wanted AS (
  SELECT i, item_id, t, CAST(count(*) AS BIGINT) AS times
  FROM (SELECT row_number() OVER () AS i, item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY i, item_id, t),
held AS (SELECT d, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT d, unnest(w) AS t FROM docs) WHERE t IN (SELECT t FROM wanted) GROUP BY d, t),
weights AS (
  SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight
  FROM held, corpus GROUP BY t, n_docs),
scored AS (
  SELECT i, item_id, d, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM wanted JOIN held USING (t) JOIN weights USING (t) JOIN lengths USING (d) GROUP BY i, item_id, d, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""
