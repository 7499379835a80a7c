"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

from vitalweave.llm.quality import BOILERPLATE, LineRules

_RULES = LineRules()


def _count(text: str, characters: str) -> str:
    return f"(length({text}) - length(translate({text}, '{characters}', '')))"


_SPACE = "[\\x20\\x09-\\x0D]+"
_NOTICE = " OR ".join(f"contains(lower(line), '{p}')" for p in BOILERPLATE)

QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda x: x <> '') AS words FROM d),
win AS (SELECT r, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5),
runs AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(words[i : i + 4], ' ')) AS n FROM win),
reps AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM runs WHERE n > 1) GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT r, line, len(list_filter(regexp_split_to_array(line, '{_SPACE}'), lambda x: x <> '')) AS n FROM l),
judged AS (SELECT r, line, n,
    {_count('line', '#*$%&<>~^=_')} + 0.5 * {_count('line', '!?')} > {_RULES.symbols_per_word} * greatest(n, 1)
    OR ({_count('line', '|»›•·')} >= {_RULES.separators} AND {_count('line', '|»›•·')} > {_RULES.separators_per_word} * greatest(n, 1))
    OR (({_NOTICE}) AND greatest(n, 1) <= {_RULES.notice_words}) AS bad FROM lw),
s AS (SELECT r, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines,
    coalesce(sum(n) FILTER (bad), 0) AS n_lost_words FROM judged GROUP BY r),
f AS (SELECT d.r, doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST({_count('text', '#*$%&|<>')} AS BIGINT) AS n_symbols,
    CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(n_lost_words AS BIGINT) AS n_lost_words
  FROM d JOIN w USING (r) JOIN s USING (r) LEFT JOIN reps USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_lost_words <= {_RULES.lost} * n_words AS kept, n_lost_words
FROM f
"""

_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
b AS (SELECT item_id, {_WORDS.format("text")} AS words FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(10, len(words)) AS n, array_to_string(words[i : i + least(10, len(words)) - 1], ' ') AS w
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM b WHERE len(words) > 0)),
dw AS (SELECT r, i, n, array_to_string(words[i : i + n - 1], ' ') AS w
  FROM (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(words) >= n)),
h AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, w)),
p AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r)
"""

_SHINGLES = f"""d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT r, array_to_string(words[i : i + least(5, len(words)) - 1], ' ') AS g
  FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM d WHERE len(words) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r)"""

NGRAM_JOIN = f"""
WITH RECURSIVE {_SHINGLES},
p AS (SELECT a.r AS a, b.r AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (r)
JOIN (SELECT reach.a AS r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY ALL) c USING (r)
"""

REPEATS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT r, i, md5(array_to_string(words[i + 1 : i + 50], ' ')) AS h FROM (SELECT r, words, unnest(range(0, len(words) - 49)) AS i FROM d WHERE len(words) >= 50)),
t AS (SELECT r, i FROM p WHERE h IN (SELECT h FROM p GROUP BY h HAVING count(*) > 1)),
g AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS k FROM (
  SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM t))
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(min(i) AS BIGINT) AS first, CAST(max(i) + 50 AS BIGINT) AS "end"
FROM g JOIN d USING (r) GROUP BY r, k, d.doc_id, d.words
"""

EXACT_COPIES = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(text) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) WINDOW w AS (PARTITION BY text)
"""

RANKED_SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
b AS (SELECT row_number() OVER () AS b, item_id, {_WORDS.format("coalesce(text, '')")} AS words FROM benchmark),
q AS (SELECT DISTINCT b, unnest(words) AS term FROM b),
c AS (SELECT count(*) FILTER (len(words) > 0) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS n_terms FROM d),
t AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(words) AS n, unnest(words) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM t, c GROUP BY term, n_docs),
s AS (SELECT b, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN t USING (term) JOIN w USING (term), c GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k JOIN b USING (b) WHERE rank <= 50
"""

_CRC_BITS = "list_reduce([xor(a, x) & 255, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))"
_CRC32 = f"""xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length({{0}}) + 1), lambda i: CAST(ascii(substr({{0}}, CAST(i AS INT), 1)) AS BIGINT))),
    lambda a, x: xor(a >> 8, {_CRC_BITS})))"""

PREFIX_TRIE = f"""
WITH t AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, g) AS p, g, b FROM (
  SELECT conv_id AS c, turn, sha256(length(role) || ':' || role || text) AS g, strlen(text) AS b FROM (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL))),
k AS (SELECT c, {_CRC32.format("CAST(c AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT k.c, p, g, b FROM k JOIN t ON t.c = k.c - k.c % 5 AND p <= h UNION ALL SELECT c, p, g, b FROM t JOIN k USING (c) WHERE p > h),
m AS (SELECT c, row_number() OVER w AS d, sha256(string_agg(g, '') OVER w) AS x, b FROM r WINDOW w AS (PARTITION BY c ORDER BY p)
  UNION ALL SELECT c, 0, '', 0 FROM k),
e AS (SELECT c, max(d) AS len FROM m GROUP BY c),
n AS (SELECT d, x, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(b) AS worth,
  sha256(coalesce(string_agg(CASE WHEN d = len THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends_sha256 FROM m JOIN e USING (c) GROUP BY d, x),
p AS (SELECT m.c, m.d, n.conv_id FROM m JOIN n USING (d, x)),
u AS (SELECT n.*, p.conv_id AS parent_conv_id FROM n LEFT JOIN p ON p.c = n.conv_id AND p.d = n.d - 1),
f AS (SELECT parent_conv_id AS conv_id, d - 1 AS d, count(*) AS n_children FROM u WHERE d > 0 GROUP BY ALL),
v AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN f ON f.conv_id = u.conv_id AND f.d = u.d),
s AS (SELECT p.conv_id, p.d, count(*) FILTER (v.n_children = 0) AS n_leaves, sum(v.worth) AS saved FROM v JOIN p ON p.c = v.conv_id AND p.d <= v.d GROUP BY ALL)
SELECT v.conv_id, v.d AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM v JOIN s ON s.conv_id = v.conv_id AND s.d = v.d
"""
