"""DuckDB SQL for the operators that SQL can express, written apart from their Spark plans."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]"
GAP = r"[\x20\x09-\x0D]"

HOST_RULES = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS row_id, doc_id, source, COALESCE(text, '') AS t FROM documents
),
split AS (
  SELECT *, regexp_extract_all(t, '{WORD}+') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines
  FROM texts
),
placed AS (SELECT row_id, unnest(words) AS a, generate_subscripts(words, 1) AS p FROM split),
windows AS (
  SELECT row_id, p, a, lead(a, 1) OVER w AS b, lead(a, 2) OVER w AS c FROM placed
  WINDOW w AS (PARTITION BY row_id ORDER BY p)
),
twice AS (
  SELECT row_id, p, c IS NOT NULL AND count(*) OVER (PARTITION BY row_id, a, b, c) > 1 AS again FROM windows
),
covered AS (
  SELECT row_id, again OR lag(again, 1, false) OVER w OR lag(again, 2, false) OVER w AS inside FROM twice
  WINDOW w AS (PARTITION BY row_id ORDER BY p)
),
repeats AS (SELECT row_id, count(*) FILTER (WHERE inside) AS n FROM covered GROUP BY row_id),
counts AS (
  SELECT s.row_id, s.doc_id, s.source, CAST(len(s.words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(s.t, '{GAP}+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(s.t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(s.lines) - len(list_distinct(s.lines)) AS BIGINT) AS n_dup_lines,
         CAST(COALESCE(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM split s LEFT JOIN repeats r ON r.row_id = s.row_id
),
flagged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS k, CAST(count(*) FILTER (WHERE base_failed) AS DOUBLE) / count(*) AS p
  FROM flagged GROUP BY source
),
corpus AS (SELECT CAST(sum(k) AS DOUBLE) / sum(n) AS m, CAST(sum(n) AS DOUBLE) AS total, count(*) AS hosts FROM hosts),
-- Spread between hosts: its expectation is m (1 - m) times the sum of (1 - n / total) (1 + (n - 1) r), solved for r.
spread AS (
  SELECT m, hosts, sum(n * (p - m) * (p - m)) AS seen, m * (1 - m) * sum(1 - n / total) AS alike, m * (1 - m) * sum((1 - n / total) * (n - 1)) AS per_r
  FROM hosts, corpus GROUP BY m, hosts
),
prior AS (
  SELECT m, CASE WHEN hosts > 1 AND m > 0 AND m < 1 AND per_r > 1e-9 * m * (1 - m) AND (seen - alike) / per_r > 1e-9
                 THEN least(greatest(per_r / (seen - alike) - 1, 1.0), 1e6) ELSE 20.0 END AS strength
  FROM spread
),
verdicts AS (SELECT source, n, k, (k + m * strength) / (n + strength) AS rate FROM hosts, prior)
SELECT f.doc_id, f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, f.base_failed,
       NOT f.base_failed AND v.rate <= 0.5 AS kept, v.n AS host_n, CAST(v.k AS BIGINT) AS host_failures, round(v.rate, 9) AS host_rate
FROM flagged f JOIN verdicts v ON v.source IS NOT DISTINCT FROM f.source
"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Only documents that share a term with an item can score; all of these are scored and ranked.
LEXICAL_SEARCH = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS row_id, doc_id,
         regexp_extract_all(translate(COALESCE(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS terms
  FROM documents
),
totals AS (SELECT CAST(count(*) FILTER (WHERE len(terms) > 0) AS BIGINT) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM texts),
occurs AS (
  SELECT row_id, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT row_id, doc_id, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM texts) GROUP BY ALL
),
asked AS (
  SELECT item_id, term, CAST(count(*) AS BIGINT) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(COALESCE(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark)
  GROUP BY ALL
),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM occurs GROUP BY term), totals
),
scored AS (
  SELECT a.item_id, o.row_id, o.doc_id,
         CAST(sum(a.times * w.w * ((1000000000 * o.tf) // (1000 * o.tf + 12 * (75 + (25 * o.n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked a JOIN weights w USING (term) JOIN occurs o USING (term), totals
  GROUP BY a.item_id, o.row_id, o.doc_id
),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""

ORACLE_SQL = {"op3_host_rules": HOST_RULES, "op13_bit_sliced_search": LEXICAL_SEARCH}
