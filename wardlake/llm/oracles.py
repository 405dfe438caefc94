"""DuckDB SQL for the rows of the registered queries that SQL can express."""

# The limits of the queries.
_BLANKS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_LINE = "coalesce(text, '')"

OP3 = f"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, source, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM base),
m AS (
  SELECT doc_id, source, t, len(ws) AS n_words,
         coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls,
         ws
  FROM w),
windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS win
  FROM m, unnest(generate_series(1, n_words - 7)) AS g(i) WHERE n_words > 8),
twice AS (
  SELECT doc_id, i FROM windows
  QUALIFY count(*) OVER (PARTITION BY doc_id, win) >= 2),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM twice, unnest(generate_series(0, 7)) AS g(k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, source, t, l,
         lower(regexp_replace(trim(l, {_BLANKS}), '[\\x20\\x09-\\x0D]{{2,}}|[\\x09-\\x0D]', ' ', 'g'))
           AS k
  FROM (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS l FROM base)
  WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
hosts AS (SELECT source, count(DISTINCT t) AS texts FROM base GROUP BY source),
above AS (
  SELECT source, k FROM lines JOIN hosts USING (source)
  GROUP BY source, k, texts
  HAVING count(DISTINCT t) >= 10 AND count(DISTINCT t) > 0.1 * texts),
removed AS (
  SELECT doc_id, sum(len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+'))) AS n
  FROM lines JOIN above USING (source, k) GROUP BY doc_id),
s AS (
  SELECT m.doc_id, n_words, word_chars, n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words,
         coalesce(removed.n, 0) AS n_boilerplate
  FROM m LEFT JOIN covered USING (doc_id) LEFT JOIN removed USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
       n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, n_boilerplate::BIGINT AS n_boilerplate,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
         AND NOT (n_boilerplate > 0 AND (n_words - n_boilerplate < 10
                  OR n_words - n_boilerplate < 0.3 * n_words)) AS kept
FROM s"""

OP8 = f"""
WITH lines AS (
  SELECT doc_id, i, l, translate(trim(l, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(generate_series(1, len(ls))) AS i, unnest(ls) AS l
        FROM (SELECT doc_id, string_split({_LINE}, chr(10)) AS ls FROM documents))),
common AS (
  SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT doc_id, i, l, last IS NOT NULL AND doc_id IS DISTINCT FROM last AS gone
  FROM lines LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

ORACLES = {"op3_quality_rules": OP3, "op8_line_dedup": OP8}
