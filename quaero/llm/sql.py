"""DuckDB counterparts of the operators that SQL can express."""

#: Base columns of every text in SQL; kept and removed_chars by the cross-document line counts.
QUALITY_RULES = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[ \t-\r]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ls FROM d),
pos AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
win AS (SELECT rid, i, list(word) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS eight,
        count(*) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS n FROM pos),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, eight) AS c FROM win WHERE n = 8) WHERE c > 1),
cover AS (SELECT rid, sum(least(8, i - coalesce(prev, -100)))::BIGINT AS n_repeat_words
          FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS prev FROM dup) GROUP BY rid),
base AS (SELECT w.rid, w.doc_id, host, ls, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
        FROM w LEFT JOIN cover USING (rid)),
line AS (SELECT rid, host, regexp_replace(trim(regexp_replace(lower(l), '[ \t-\r]+', ' ', 'g')), '[0-9]', '0', 'g') AS h,
         sum(length(regexp_replace(l, '[ \t-\r]+', '', 'g')))::BIGINT AS chars FROM (SELECT rid, host, unnest(ls) AS l FROM base) GROUP BY 1, 2, 3),
common AS (SELECT host, h FROM line GROUP BY 1, 2 HAVING count(*) > 20),
gone AS (SELECT rid, sum(chars)::BIGINT AS removed_chars FROM line JOIN common USING (host, h) GROUP BY 1),
f AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM base LEFT JOIN gone USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND coalesce(removed_chars, 0) <= 0.8 * word_chars) AS kept, coalesce(removed_chars, 0)::BIGINT AS removed_chars FROM f
"""

#: The digests from the input itself; formatted_chars from the template's lengths.
CHAT_FORMAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, role = 'assistant' AS reply,
  length(text) + (length(text) - length(replace(text, '\', ''))) + coalesce(len(regexp_extract_all(text, '</?s>|\[/?INST\]')), 0) AS esc FROM c),
r AS (SELECT *, CASE WHEN reply THEN esc + 5 ELSE 10 + length(role) + 1 + esc + 8 END AS size FROM e),
p AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS stop FROM r)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE reply), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE reply), '')) AS loss_sha256,
  (coalesce(sum(stop) FILTER (WHERE reply), 0) + max(stop) - coalesce(max(stop) FILTER (WHERE reply), 0))::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""
