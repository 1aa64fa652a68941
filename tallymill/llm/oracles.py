"""SQL twins of the operators that SQL can express, over the whole tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM sized),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
  FROM d, ks WHERE len(w) >= k),
hit AS (SELECT doc_id, i, k, item_id FROM dw JOIN win USING (k, s)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * c >= 80 * (na + nb - c)),
sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM sets UNION SELECT doc_id, sides.b FROM reach JOIN sides ON reach.r = sides.a),
least_of AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least_of USING (doc_id)"""


_SMALL = "translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: crc32 with the table of its polynomial, over the UTF-8 bytes of ``<doc_id>:<run>`` (code points below U+0100 only).
VARIANTS = f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
  lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')) AS run FROM documents),
small AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, {_SMALL} AS run, count(*) AS k FROM runs GROUP BY ALL),
bytes AS (SELECT run, k, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, unicode(c) - 64] END)) AS b FROM small),
hashed AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
made AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, k FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM made GROUP BY word HAVING length(word) >= 7 AND sum(k) >= 2),
cuts AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)),
near AS (SELECT DISTINCT a.word, b.word AS other, a.n, b.n AS other_n FROM cuts a JOIN cuts b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT w.word, c.word, w.n, c.n FROM words w JOIN cuts c ON c.rest = w.word UNION SELECT c.word, w.word, c.n, w.n FROM words w JOIN cuts c ON c.rest = w.word),
best AS (SELECT word, n, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word, n),
formed AS (SELECT word, other AS form, other_n AS form_n FROM best WHERE other_n >= 10 * n),
reach AS (SELECT word, form AS root, 1 AS d FROM formed UNION ALL SELECT reach.word, formed.form, d + 1 FROM reach JOIN formed ON formed.word = reach.root),
ends AS (SELECT word, arg_max(root, d) AS root FROM reach GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, words.n, coalesce(n_near, 0) AS n_near, form_n
FROM words LEFT JOIN (SELECT word, n_near FROM best) USING (word) LEFT JOIN formed USING (word) LEFT JOIN ends USING (word)"""

_CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|/?SYS\]|ANS\]|/?ROLE\]|SAYS\]|PART\]|(?:IMAGE|AUDIO|DOC):)"
_INLINE = r"!\[[^\[\]\n]*\]\([^()\x20\n]+(?:\x20=[0-9]+x[0-9]+)?\)"
_NUMBER = lambda pattern, group=1: f"TRY_CAST(nullif(regexp_extract(r, '{pattern}', {group}), '') AS DOUBLE)"
_CLIP = r"#t=([0-9]+(?:\.[0-9]+)?),([0-9]+(?:\.[0-9]+)?)"
#: Escapes add one character each; a placeholder has its kind and the number of its part.
CHATS = rf"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
cut AS (SELECT *, length(regexp_replace(role, '{_CONTROL}', '\1\\\2\3', 'g')) AS role_chars, regexp_split_to_array(text, '{_INLINE}') AS gaps,
  list_transform(regexp_extract_all(text, '{_INLINE}'), lambda x: regexp_extract(x, '\]\((.*)\)$', 1)) AS refs FROM m),
typed AS (SELECT *, list_transform(refs, lambda r: struct_pack(r := r, k := CASE WHEN regexp_matches(r, '\.(?:mp3|wav|flac|ogg|m4a)(?:[#\x20)]|$)') THEN 'audio'
  WHEN regexp_matches(r, '\.(?:pdf|docx|pptx|xlsx|txt|html)(?:[#\x20)]|$)') THEN 'document' ELSE 'image' END)) AS marks FROM cut),
sized AS (SELECT *, coalesce(list_sum(list_transform(gaps, lambda g: length(regexp_replace(g, '{_CONTROL}', '\1\\\2\3', 'g')))), 0)
  + coalesce(list_sum(list_transform(marks, lambda x, i: CASE x.k WHEN 'document' THEN 6 ELSE 8 END + length(CAST(2 * i - 1 AS VARCHAR)))), 0)
  + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 11 WHEN 'assistant' THEN 9 ELSE 19 + role_chars END AS chars,
  coalesce(list_sum(list_transform(marks, lambda x: list_sum(list_transform([x.r], lambda r: CASE x.k
    WHEN 'image' THEN coalesce(greatest(4, least(16384, ceil({_NUMBER('\\x20=([0-9]+)x')} / 28) * ceil({_NUMBER('\\x20=[0-9]+x([0-9]+)')} / 28))), 256)
    WHEN 'audio' THEN coalesce(ceil(greatest({_NUMBER(_CLIP, 2)} - {_NUMBER(_CLIP)}, 0) * 25), 750)
    ELSE coalesce({_NUMBER('#pages=([0-9]+)')}, 1) * 1024 END)))), 0) AS tokens FROM typed)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(chars) AS BIGINT) AS formatted_chars, CAST(sum(tokens) AS BIGINT) AS attachment_tokens
FROM sized GROUP BY conv_id"""
