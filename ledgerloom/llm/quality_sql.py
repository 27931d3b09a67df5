"""DuckDB SQL for the rules of ``quality``."""

from __future__ import annotations

from ledgerloom.llm.quality import CHARACTER_DISTANCE, COMMON_WORDS, LEAST_REFERENCE, LEAST_WORDS, PUNCTUATION, REFERENCES, WINDOW, WORD_DISTANCE

LISTED = sorted({w for ws in COMMON_WORDS.values() for w in ws})
CLASSES = ["[a-z]+", r"[\x20\x09-\x0D]+", "[A-Z]+", r"[.,;:!?\"''()-]+", "[0-9]+", r"\p{L}+"]
_REST = ["t", *(f"r{i}" for i in range(1, 7))]
_STEPS = "\n".join(f"s{i} AS (SELECT *, regexp_replace({_REST[i]}, '{c}', '', 'g') AS {_REST[i + 1]} FROM {'w' if not i else f's{i - 1}'})," for i, c in enumerate(CLASSES))
_SHARES = "list_transform({0}, lambda x: CASE WHEN list_sum({0}) > 0 THEN x / list_sum({0}) ELSE 0 END)"
_HALF = "CASE WHEN {0} > 0 THEN {0} * log2({0} / (({0} + {1}) / 2)) ELSE 0 END"
_DISTANCE = "sqrt(greatest(list_sum(list_transform(list_zip({0}, {1}), lambda p: " + _HALF.format("p[1]", "p[2]") + " + " + _HALF.format("p[2]", "p[1]") + ")) / 2, 0))"
_OWN = ", ".join(f"'{lang}': [{', '.join(str(LISTED.index(w) + 1) for w in words)}]" for lang, words in COMMON_WORDS.items())
_PUNCTUATION = PUNCTUATION.replace("'", "''")
_LIMITS = [f"({low} + {noise} / sqrt(greatest(n_words, 1)))" for low, noise in (CHARACTER_DISTANCE, WORD_DISTANCE)]

QUALITY = f"""
WITH b AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM b),
{_STEPS}
x AS (SELECT rid, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS win FROM w, LATERAL (SELECT unnest(range(1, len(ws) - {WINDOW - 2})) AS i) WHERE len(ws) >= {WINDOW}),
st AS (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM (SELECT *, count(*) OVER (PARTITION BY rid, win) AS c FROM x) y WHERE c > 1),
rep AS (SELECT rid, sum(least({WINDOW}, coalesce(nx - i, {WINDOW}))) AS n FROM st GROUP BY rid),
m AS (SELECT s5.rid, doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(t) - (length(r1) - length(r2)) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
  [{", ".join(f"(length({a}) - length({z}))::DOUBLE" for a, z in zip(_REST, _REST[1:], strict=False))}, length(r6)::DOUBLE] AS classes,
  list_transform(ws, lambda x: rtrim(lower(x), '{_PUNCTUATION}')) AS lw FROM s5 LEFT JOIN rep ON s5.rid = rep.rid),
j AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  list_transform({LISTED}, lambda k: len(list_filter(lw, lambda x: x = k))::DOUBLE) AS times FROM m),
ref AS (SELECT lang AS ref_lang, sum(n_words) AS rn, [{", ".join(f"sum(classes[{i}])" for i in range(1, 8))}] AS rc, [{", ".join(f"sum(times[{i + 1}])" for i in range(len(LISTED)))}] AS rt
  FROM j WHERE NOT base_failed AND lang IS NOT NULL GROUP BY lang HAVING sum(n_words) >= {LEAST_REFERENCE} ORDER BY sum(n_words) DESC, lang LIMIT {REFERENCES}),
o AS (SELECT ref_lang, list_transform(rc, lambda x: x / list_sum(rc)) AS rc, MAP {{{_OWN}}}[ref_lang] AS own, rn, rt FROM ref),
o2 AS (SELECT ref_lang, rc, own, list_transform(own, lambda i: rt[i] / rn) AS head FROM o),
e AS (SELECT rid, classes, n_words, rc, own, list_append(head, 1 - list_sum(head)) AS rw, list_transform(own, lambda i: times[i] / greatest(n_words, 1)) AS mine FROM j, o2),
d AS (SELECT rid, {_DISTANCE.format(_SHARES.format("classes"), "rc")} AS cd, CASE WHEN own IS NOT NULL THEN {_DISTANCE.format("list_append(mine, greatest(1 - list_sum(mine), 0))", "rw")} END AS wd FROM e),
n AS (SELECT rid, round(least(min(cd), 1.0), 6) AS cd, round(least(min(wd), 1.0), 6) AS wd FROM d GROUP BY rid),
f AS (SELECT j.*, coalesce(cd, 0.0) AS char_distance, coalesce(wd, 0.0) AS word_distance FROM j LEFT JOIN n ON j.rid = n.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_words >= {LEAST_WORDS} AND ((char_distance > {_LIMITS[0]} AND (lang IS NULL OR lang IN (SELECT ref_lang FROM o))) OR (word_distance > {_LIMITS[1]} AND (lang IS NULL OR lang IN (SELECT ref_lang FROM o WHERE own IS NOT NULL))))) AS kept, char_distance, word_distance FROM f
"""
