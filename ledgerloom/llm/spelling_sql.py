"""The spelling variants in DuckDB's SQL, for whole tables: crc32 by its table, near words by shared patterns."""

from __future__ import annotations

from ledgerloom.llm.spelling import DAMAGED, LENGTH, OCCURRENCES, RATIO

#: Two words of one length are near if they agree but for one place; else the shorter is the longer without one letter.
VARIANTS = f"""
WITH RECURSIVE crc AS MATERIALIZED (
    SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), spans AS (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), each AS (
    SELECT doc_id, run, count(*) AS n FROM spans GROUP BY ALL
), coded AS (
    SELECT run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c) >> 6), 128 + unicode(c) % 64]::BIGINT[] END)) AS bytes FROM each
), hashed AS (
    SELECT run, n, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[xor(c % 256, b) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM coded, crc
), words AS (
    SELECT CASE WHEN h % {DAMAGED} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, sum(n)::BIGINT AS n
    FROM hashed GROUP BY ALL
), vocabulary AS MATERIALIZED (
    SELECT word, n FROM words WHERE length(word) >= {LENGTH} AND n >= {OCCURRENCES}
), patterns AS MATERIALIZED (
    SELECT word, n, unnest(range(1, length(word) + 1)) AS place, substr(word, 1, place - 1) || '*' || substr(word, place + 1) AS masked, substr(word, 1, place - 1) || substr(word, place + 1) AS shorter FROM vocabulary
), near AS (
    SELECT a.word, b.word AS near, b.n AS near_n FROM patterns a JOIN patterns b ON a.masked = b.masked AND a.word <> b.word
    UNION SELECT p.word, v.word, v.n FROM patterns p JOIN vocabulary v ON p.shorter = v.word
    UNION SELECT v.word, p.word, p.n FROM patterns p JOIN vocabulary v ON p.shorter = v.word
), best AS (
    SELECT word, count(*) AS n_near, max(near_n) AS most FROM near GROUP BY word
), named AS (
    SELECT near.word, min(near) AS first FROM near JOIN best ON near.word = best.word AND near_n = most GROUP BY near.word
), forms AS MATERIALIZED (
    SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {RATIO} * v.n THEN first END AS form, CASE WHEN most >= {RATIO} * v.n THEN most END AS form_n
    FROM vocabulary v LEFT JOIN best ON v.word = best.word LEFT JOIN named ON v.word = named.word
), ways AS (
    SELECT word, word AS at_word, 0 AS steps FROM forms
    UNION ALL SELECT ways.word, form, steps + 1 FROM ways JOIN forms ON at_word = forms.word WHERE form IS NOT NULL
), ends AS (
    SELECT word, arg_max(at_word, steps) AS root FROM ways GROUP BY word
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""
