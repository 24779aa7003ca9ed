"""op12: near words, form and root of every frequent word."""

from kgspark.llm.common import documents
from kgspark.llm.registry import query
from kgspark.llm.spelling_variants import spelling_variants, vocabulary

STEP = "CASE WHEN {0} & 1 = 1 THEN xor(({0}) >> 1, 3988292384) ELSE ({0}) >> 1 END"
SQL = r"""
WITH RECURSIVE crc0 AS (SELECT i, i AS v FROM (SELECT unnest(range(256))::BIGINT AS i)),
""" + "".join(f"crc{k + 1} AS (SELECT i, {STEP.format('v')} AS v FROM crc{k}),\n" for k in range(8)) + r"""
tab AS (SELECT list(v ORDER BY i) AS t FROM crc8),
runs AS MATERIALIZED (
    SELECT doc_id, run, count(*) AS times, length(run) AS len FROM (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[a-zÀ-ÿ]+')) AS run FROM documents)
    WHERE length(run) >= 6 GROUP BY doc_id, run),
summed AS MATERIALIZED (
    SELECT run, len, times, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
        string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
        lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, 128 + (ord(c) & 63)::BIGINT] END))),
        lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295::BIGINT) AS h
    FROM runs, tab),
words AS MATERIALIZED (
    SELECT word, sum(times)::BIGINT AS n FROM (
        SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, (h % len)::BIGINT) || substring(run, (h % len)::BIGINT + 2)
                    ELSE run END AS word, times FROM summed)
    WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
dropped AS MATERIALIZED (
    SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest
    FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (
    SELECT a.word, b.word AS near, b.n FROM dropped a JOIN dropped b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT w.word, d.word, d.n FROM words w JOIN dropped d ON w.word = d.rest
    UNION SELECT d.word, w.word, w.n FROM words w JOIN dropped d ON w.word = d.rest),
best AS (SELECT word, count(*) AS n_near, max(n) AS top FROM near GROUP BY word),
forms AS MATERIALIZED (
    SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, min(x.near) AS form, any_value(x.n) AS form_n
    FROM words w LEFT JOIN best b USING (word)
    LEFT JOIN near x ON x.word = w.word AND x.n = b.top AND x.n >= 5 * w.n
    GROUP BY w.word, w.n, b.n_near),
walk(word, reached) AS (SELECT word, word FROM forms UNION ALL
                   SELECT walk.word, f.form FROM walk JOIN forms f ON f.word = walk.reached WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.reached AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN walk USING (word) JOIN forms e ON e.word = walk.reached WHERE e.form IS NULL
"""


@query("op12_spelling_variants", SQL)
def op12_spelling_variants(spark, sf_dir):
    return spelling_variants(vocabulary(documents(spark, sf_dir)))
