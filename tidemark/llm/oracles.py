"""DuckDB SQL for the queries that SQL can express."""

_WORDS2 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = f"""
WITH d AS (SELECT doc_id, {_WORDS2} AS w FROM documents),
b AS (SELECT item_id, {_WORDS2} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, n WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, s)),
spots AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP8 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
first AS (SELECT s, min(doc_id) AS lead FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN first USING (s) WHERE lead < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n
  FROM word LEFT JOIN (SELECT doc_id, p, true AS g FROM gone) USING (doc_id, p) WHERE g IS NULL GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP6 = rf"""
WITH d AS (SELECT doc_id, source AS host, text, {_WORDS} AS w, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT doc_id, s FROM win GROUP BY doc_id, s HAVING count(*) > 1),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 5)) AS p FROM win JOIN twice USING (doc_id, s)) GROUP BY doc_id),
line AS (
  SELECT doc_id, host, text, x, regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[^\x20\x09-\x0D]+') AS lw
  FROM (SELECT doc_id, host, text, unnest(l) AS x FROM d)),
full_line AS (SELECT doc_id, host, text, x, array_to_string(lw, ' ') AS norm, len(lw) AS n FROM line WHERE len(lw) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM full_line GROUP BY doc_id),
hosts AS (SELECT host, count(DISTINCT text) AS texts FROM d GROUP BY host),
often AS (SELECT host, norm, count(DISTINCT text) AS docs FROM full_line GROUP BY host, norm),
gone AS (
  SELECT doc_id, sum(n) AS n FROM full_line JOIN often USING (host, norm) JOIN hosts USING (host)
  WHERE docs > 20 AND docs > texts * CAST(0.05 AS DOUBLE) GROUP BY doc_id),
base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars,
    (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS removed_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (n_words - removed_words < CAST(0.3 AS DOUBLE) * n_words) AS kept
FROM base
"""

OP13 = f"""
WITH d AS (SELECT doc_id, unnest({_WORDS2}) AS x FROM documents),
tf AS (SELECT doc_id, x, count(*)::BIGINT AS tf FROM d GROUP BY doc_id, x),
len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_all FROM len),
df AS (SELECT x, count(*)::BIGINT AS df FROM tf GROUP BY x),
b AS (SELECT item_id, unnest({_WORDS2}) AS x FROM benchmark),
w AS (
  SELECT x, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM df, total),
m AS (SELECT doc_id, 100 - 75 + ((75 * n * n_docs) // n_all) AS m FROM len, total),
s AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM b JOIN w USING (x) JOIN tf USING (x) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
WHERE rank <= 10
"""
